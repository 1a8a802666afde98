"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for every document. The ledger stores the measurements and one bit a rule; policies are versioned
masks over those bits, and ablations are bitwise aggregates over the ledger, so neither reads a text again.
DataFrame expressions only: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`fails` is a SQL condition over the measurements; integers only, so that borders are exact."""

    name: str
    fails: str


#: The order fixes the bits: rule i has bit 2**i. Append only; a change of a rule is a new rule.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "100 * n_symbols > 25 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("shouting", "100 * n_upper > 40 * word_chars"),
    Rule("exclaiming", "100 * n_exclaim > 40 * n_words"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("digits", "100 * n_digits > 40 * word_chars"),
)

#: Versions of the policy: the rules that reject a document. v1 is the base alone.
POLICIES = {
    "v1": ("too_few_words", "repeated_windows"),
    "v2": ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "shouting", "exclaiming", "word_length", "digits"),
}


def mask_of(names, rules=RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in names)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more in the array.

    Windows are put in order by their hashes, so equal ones are neighbours, and neighbours are held against each other word by
    word, so a chance agreement of hashes does not count. A fold over the sorted places counts every word once. In texts of fewer
    than 4,096 words hash (52 bits) and place share one number; in longer ones they are a pair, and the hash keeps all its bits.
    """
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  binds a value once; a plain reference is evaluated for every element
    n = F.size(words)
    word = lambda i, k: F.get(words, i + k)
    every = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    hash_of = lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2))
    equal = lambda i, j: (word(i, 0) == word(j, 0)) & (word(i, 1) == word(j, 1)) & (word(i, 2) == word(j, 2))

    def places(windows: Column, place, alike) -> Column:
        same = lambda x, y: y.isNotNull() & alike(x, y) & equal(place(x), place(y))
        twice = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return let(F.sort_array(windows), lambda s: F.transform(twice(s), place))

    low = F.lit((1 << 12) - 1).cast("long")
    short = F.transform(every, lambda i: hash_of(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    long_ = F.transform(every, lambda i: F.struct(hash_of(i).alias("h"), i.alias("i")))
    found = F.when(
        n < 1 << 12, places(short, lambda x: x.bitwiseAND(low).cast("int"), lambda x, y: x.bitwiseXOR(y).between(0, low))
    ).otherwise(places(long_, lambda x: x["i"], lambda x, y: x["h"] == y["h"]))

    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
    count = F.aggregate(F.sort_array(found), start, step, lambda a: a["n"].cast("long"))
    return F.when(n >= 4, count).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements; a null text measures as an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    count = lambda kept: F.length(F.regexp_replace(body, f"[^{kept}]+", "")).cast("long")
    one = F.transform(F.array(words_of(F.col(text))), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    two = F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return docs.select(
        "*",
        F.get(one, F.lit(0)).alias("_w"),
        F.get(two, F.lit(0)).alias("_l"),
        F.length(F.regexp_replace(body, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        count(r"#*$%&|<>").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count("0-9").alias("n_digits"),
        count("!").alias("n_exclaim"),
    ).select(
        *docs.columns,
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.d").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
        "n_upper",
        "n_digits",
        "n_exclaim",
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaim")


def ledger(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The columns of `docs`, the measurements and `fail_bits` (long).

    Null and empty texts fail `too_few_words` alone. Columns of `docs` that have the name of a measurement give way to it.
    """
    bare = docs.drop(*(c for c in docs.columns if c in (*MEASURES, "fail_bits", "_w", "_l")))
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)), F.lit(0).cast("long"))
    return measured(bare, text).withColumn("fail_bits", bits)


def judged(rows: DataFrame, policy: str = "v2", base: str = "v1", rules=RULES) -> DataFrame:
    """Apply a policy to a ledger: adds `base_failed` and `kept`."""
    failed = lambda v: F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[v], rules))) != 0
    return rows.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(base) & ~failed(policy))


def ablation(rows: DataFrame, policy: str = "v2", rules=RULES) -> DataFrame:
    """One row a rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    Documents are first counted by their masked bits, of which there are at most 2**rules, so the shuffle carries counts only.
    """
    mask = mask_of(POLICIES[policy], rules)
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in POLICIES[policy])))
    x = by_bits.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, others = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & (others == 0)).alias("n_only"), total(others == 0).alias("n_kept_without"), F.bit_or(F.when(hit, F.col("bits"))).alias("bits_together"))
