"""Personal data: spans from high-recall generators, scored by gradient-boosted trees, selected by calibrated thresholds.

Four base kinds (email, ip, card, phone) have fixed formats and always stay. Other generators propose spans that may overlap:
telephone numbers without a country code, addresses with their signs spelled out, card numbers by their grouping, secrets by
their names, prefixes and key blocks, bank accounts, national numbers, dates of birth, street addresses and names of persons.
Features are what the span looks like, whether its check digits are right, and the words around it. Trees are grown on the
driver from half of a small labelled table (`labelled`, some thousand short texts put together by rule) whose features come
from the same expressions; they are then a sum of CASE expressions, so scoring stays in DataFrame expressions. The threshold of
a generator comes from a quarter of the table that its trees haven't seen; the last quarter is held out for figures.

Regular expressions are possessive, and begin where a run of their characters begins, so that long runs take linear time.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: kind -> (what a text must hold, the pattern). Both find what the plain forms of the contract find.
BASE = {
    "email": ("@", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A run of digit groups that may be a telephone or card number.
GROUPS = r"[0-9]{3}[)\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{4}"
#: Prefixes of keys that providers publish.
PREFIXED = (
    "AKIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{20,}+", "sk-[A-Za-z0-9_-]{20,}+", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+",
    "xox[abprs]-[A-Za-z0-9-]{10,}+", "AIza[A-Za-z0-9_-]{30,}+", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
)
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Square|Terrace"
CALLED = r"my name is |name: ?|signed,? |patient |(?<![a-z])(?:mr|mrs|ms|dr|herr|frau|mme)\.? "
NAME = r"\p{Lu}[\p{L}'-]{1,20}+"

#: Candidates of the method: generator -> (kind, what the lower-cased text must hold, what the text must match, pattern).
CANDIDATES = {
    "spelled": ("email", ("(at)", "[at]", " at "), "", rf"(?<!{LOCAL}){LOCAL}++(?: ?[(\[](?i:at)[)\]] ?| (?i:at) )[A-Za-z0-9-]++(?:(?: ?[(\[](?i:dot)[)\]] ?| (?i:dot) |\.)[A-Za-z0-9-]++)++"),
    "grouped": ("card", (), GROUPS, r"(?<![0-9])(?<![0-9][\x20.-])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\x20.-]?[0-9])"),
    "national": ("phone", (), GROUPS, r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    "secret": ("secret", ("token", "secret", "passw", "key"), "", r"(?<![A-Za-z0-9])(?i:[a-z_-]{0,20}+(?<=token|secret|password|passwd|key))[\x22'\x20]{0,2}[=:][\x22'\x20]{0,2}[A-Za-z0-9_/+-]{8,}+"),
    "prefixed": ("secret", ("akia", "gh", "k-", "k_", "xox", "aiza", "eyj"), "", rf"(?<![A-Za-z0-9])(?:{'|'.join(PREFIXED)})"),
    "block": ("secret", ("private key-----",), "", r"-----BEGIN [A-Z ]{0,20}+(?<=[ ])PRIVATE KEY-----(?:[^-]++|-(?!----))*+(?:-----END [A-Z ]{0,30}+-----)?|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    "account": ("iban", (), "[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}+(?:[ ]?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])"),
    "number": ("national_id", (), "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "born": ("birth", ("born", "birth", "dob"), "[0-9]", r"(?<![0-9./-])(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9]|[./-][0-9])"),
    "street": ("address", (), "[0-9] [A-Z]", rf"(?<![0-9A-Za-z.,-])[0-9]{{1,5}}+ (?:[A-Z][a-z]{{1,15}}+ ){{1,3}}(?:{STREETS})(?![A-Za-z])"),
    "called": ("name", ("name", "signed", "patient", "mr", "ms", "dr", "herr", "frau", "mme"), "", rf"(?<=(?i:{CALLED})){NAME}(?: {NAME}){{0,2}}+"),
}
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "national_id", "birth", "address", "name")
SPANS = "array<struct<s:int,e:int,t:string>>"
SCORED = "array<struct<m:double,kind:string,s:int,e:int>>"


def let(x: Column, f) -> Column:
    """Bind a value once: a plain reference inside a higher-order function is evaluated for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def located(body: Column, pattern: str) -> Column:
    """Array of (s, e, t): start and end in code points and the text of every match, leftmost and not overlapping."""

    def fold(found: Column, gaps: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("all"))

        def step(a, i):
            s = a["at"] + F.length(F.get(gaps, i))
            e = s + F.length(F.get(found, i))
            return F.struct(e.alias("at"), F.concat(a["all"], F.array(F.struct(s.alias("s"), e.alias("e"), F.get(found, i).alias("t")))).alias("all"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["all"])

    return let(
        F.regexp_extract_all(body, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, let(F.split(body, pattern, -1), lambda gaps: fold(found, gaps))).otherwise(F.array().cast(SPANS)),
    )


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    value = lambda i: F.substring(d, -i, F.lit(1)).cast("int")
    each = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + each(i)) % 10 == 0


CHECKS = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: t.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda t: let(digits(t), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))),
    "phone": lambda t: F.length(digits(t)).between(8, 15),
}


def base_spans(body: Column, kind: str) -> Column:
    """The spans of a base kind; a match that fails its check is dropped, and nothing else tried in its place."""
    holds, pattern = BASE[kind]
    gate = body.contains(holds) if holds else body.rlike("[0-9](?:[\\x20-]?[0-9]){15}+")
    return F.when(gate, F.filter(located(body, pattern), lambda x: CHECKS[kind](x["t"]))).otherwise(F.array().cast(SPANS))


def mod97(t: Column) -> Column:
    """Whether an account number has right check digits: its fifth character on, then the first four, letters from A as 10, modulo 97."""
    bare = F.regexp_replace(t, " ", "")
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def add(a, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(bare)), F.lit(0), add) == 1


def _value(t: Column) -> Column:
    return F.regexp_extract(t, r"([A-Za-z0-9_/+-]+)$", 1)


def _near(*names: str, end: str = ""):
    pattern = rf"(?<![a-z])(?:{'|'.join(names)})(?![a-z]){end}"
    return lambda t, b, a: b.rlike(pattern)


#: Features of a candidate, by name, from its text and the 24 characters before it (lower-cased) and the one after.
FEATURES = {
    "spelled": lambda t, b, a: t.rlike(r"[(\[](?i:at)[)\]]"),
    "dotted": lambda t, b, a: t.rlike(r"(?i:dot)[)\]\x20]|\."),
    "n_digits": lambda t, b, a: F.length(digits(t)),
    "parens": lambda t, b, a: t.rlike(r"^\("),
    "value": lambda t, b, a: F.length(_value(t)),
    "value_digits": lambda t, b, a: F.length(digits(_value(t))),
    "mixed_case": lambda t, b, a: _value(t).rlike("[a-z]") & _value(t).rlike("[A-Z]"),
    "provider": lambda t, b, a: t.rlike("^(?:AKIA|gh[pousr]_|[sr]k_|xox|AIza|eyJ)"),
    "luhn": lambda t, b, a: let(digits(t), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))),
    "mod97": lambda t, b, a: F.when(t.rlike("^[A-Z]{2}[0-9]{2}") & (F.length(t) <= 44), mod97(t)).otherwise(F.lit(False)),
    "issued": lambda t, b, a: t.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    "year": lambda t, b, a: F.regexp_extract(t, "(19[0-9]{2}|20[01][0-9])", 1) != "",
    "n_words": lambda t, b, a: F.size(F.split(t, " ")),
    "call": _near("call", "phone", "tel", "telephone", "mobile", "cell", "fax", "text", "whatsapp", "dial", "contact", "reach"),
    "mail": _near("mail", "email", "e-mail", "write", "contact", "reach"),
    "pay": _near("card", "visa", "mastercard", "amex", "credit", "debit", "pay"),
    "bank": _near("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "social": _near("ssn", "social security", "social", "tax", "national", "insurance", "id"),
    "birth": _near("born", "birth", "dob", "birthday", end=r".{0,6}$"),
    "lives": _near("live", "lives", "address", "home", "at", "reside", "resides", "ship to", "deliver to"),
    "named": _near("my name is", "name", "signed", "patient", end=r"\W*$"),
    "title": _near("mr", "mrs", "ms", "dr", "herr", "frau", "mme", end=r"\W*$"),
    "other": _near("order", "invoice", "isbn", "part", "item", "ref", "serial", "version", "no", "page", "date", "model", "ticket", "case", "sku", "file", "brand", "product", end=r"\W*$"),
    "joined": lambda t, b, a: a.rlike(r"^[A-Za-z0-9]") | b.rlike(r"[A-Za-z0-9]$"),
}


def _proposal(body: Column, g: str, kind: str):
    def row(x: Column) -> Column:
        before = F.lower(F.substring(body, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))))
        after = F.substring(body, x["e"] + 1, F.lit(1))
        return F.struct(F.lit(g).alias("g"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.array(*(f(x["t"], before, after).cast("double") for f in FEATURES.values())).alias("x"))

    return row


def candidates(body: Column) -> Column:
    """Array of (g, kind, s, e, x): what the generators propose, with features. They may overlap."""
    low = F.lower(body)
    every = []
    for g, (kind, holds, matches, pattern) in CANDIDATES.items():
        gate = F.lit(not holds)
        for h in holds:
            gate = gate | low.contains(h)
        if matches:
            gate = gate & body.rlike(matches)
        none = F.array().cast("array<struct<g:string,kind:string,s:int,e:int,x:array<double>>>")
        every.append(F.when(gate, F.transform(located(body, pattern), _proposal(body, g, kind))).otherwise(none))
    return F.concat(*every)


def labelled() -> list[tuple[str, str, int]]:
    """(generator, text, 1 if the span in it is personal): formats and contexts put together."""
    rnd = random.Random(23)
    some = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    number, low, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    any_ = number + low + low.upper()
    rows: list[tuple[str, str, int]] = []

    def put(g, spans, before, after, label, times=1):
        for x in spans:
            for w in before:
                for d in after:
                    rows.extend([(g, f"{w} {x} {d}", label)] * times)

    # A first digit of 2 to 9, as area and exchange codes have.
    tel = lambda form: form.format(rnd.choice("23456789") + some(number, 2), rnd.choice("23456789") + some(number, 2), some(number, 4))
    bracketed = [tel(f) for f in ("({}) {}-{}", "({}) {} {}", "({}) {}-{}")]
    plain = [tel(f) for f in ("{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}-{}-{}")]
    put("national", bracketed + plain, ("call me on", "tel:", "fax", "my mobile is", "phone", "reach us at"), ("today", ". Then"), 1)
    put("national", bracketed, ("the words are", "and so", "in the end", ""), ("we said", "and more"), 1)
    put("national", plain, ("the words are", "and so", "in the end", ""), ("we said", "and more"), 0)
    put("national", bracketed + plain, ("order", "invoice no", "isbn", "part", "serial", "ticket"), ("shipped", "is here"), 0)

    def card(right: bool) -> str:
        d = [int(c) for c in rnd.choice("45") + some(number, 14)]
        total = sum(x if k % 2 else x * 2 - 9 * (x > 4) for k, x in enumerate(d))
        whole = "".join(map(str, [*d, (-total) % 10 if right else (-total + 3) % 10]))
        return rnd.choice("- .").join(whole[k : k + 4] for k in (0, 4, 8, 12))

    good, wrong = [card(True) for _ in range(5)], [card(False) for _ in range(5)]
    put("grouped", good + wrong, ("card", "visa", "credit card:", "pay with"), ("now", "."), 1)
    put("grouped", good, ("we saw", "then", ""), ("there", "and"), 1)
    put("grouped", wrong, ("we saw", "then", "", "order", "serial", "ref"), ("there", "and"), 0)

    spelled = ("ana (at) mail dot example dot org", "jo.li [at] example [dot] com", "sam (AT) example.org", "kim(at)post.example.net")
    worded = ("bo at mail dot example.net", "lea.f at example dot com")
    near = ("met at noon.then", "look at home.page", "sold at shop dot and then", "stayed at inn-2.late", "is at work.so", "sat at sea.it")
    put("spelled", spelled, ("email", "write to", "contact", "it was", "by"), ("", "please"), 1)
    put("spelled", worded, ("email", "write to", "contact"), ("", "please"), 1)
    put("spelled", worded, ("it was", "by"), ("", "please"), 0)
    put("spelled", near, ("we", "they", "one", "all"), ("and", ""), 0)

    keys = [f"{n}{some(c, k)}" for n in ("token = ", "api_key: ", "password=", "secret: ", "access_token='", "private_key = ") for c, k in ((hexa, 32), (any_, 20), (low + number, 14))]
    words_ = ("token = nothing_here", "key: important", "secret: ingredient", "the key = understanding", "password: forgotten", "token: economy-wide", "key = something", "the secret: patience")
    put("secret", keys, ("with", "set", ""), ("and go", ""), 1)
    put("secret", words_, ("the", "a", "", "our", "so"), ("of it", "and", ""), 0)

    provider = [f"AKIA{some(low.upper() + number, 16)}", f"ghp_{some(any_, 36)}", f"sk-{some(any_, 40)}", f"sk_live_{some(any_, 24)}", f"xoxb-{some(number, 11)}-{some(any_, 20)}", f"AIza{some(any_, 35)}", f"eyJ{some(any_, 20)}.{some(any_, 30)}.{some(any_, 24)}"]
    dull = ["sk-" + "-".join(some(low, 6) for _ in range(4)), "sk-" + some(low, 24)]
    put("prefixed", provider, ("use", "key", "", "with", "set"), ("and", ""), 1)
    provider += [f"AKIA{some(low.upper(), 15)}{rnd.choice(number)}" for _ in range(3)]
    put("prefixed", provider[-3:], ("use", "key", "", "with"), ("and", ""), 1)
    put("prefixed", dull, ("use", "", "the", "a", "with", "so"), ("and", ""), 0)
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{some(any_, 64)}\n{some(any_, 64)}\n-----END RSA PRIVATE KEY-----"
    put("block", [block, block.replace("RSA ", "")], ("use", "", "the", "file", "of", "as", "in", "with"), ("and", ""), 1)

    def account(right: bool) -> str:
        land, rest = rnd.choice(("DE", "FR", "GB", "ES")), some(number, 18)
        value = int("".join(str(int(c, 36)) for c in rest + land + "00"))
        check = 98 - value % 97 if right else (98 - value % 97) % 90 + 5
        whole = f"{land}{check:02d}{rest}"
        return rnd.choice((whole, " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))))

    good, wrong = [account(True) for _ in range(8)], [account(False) for _ in range(8)]
    put("account", good, ("iban", "account:", "transfer to", "we saw", "", "and"), ("now", ""), 1)
    put("account", wrong, ("iban", "serial", "model", "we saw", "", "part"), ("now", ""), 0)

    ssn = lambda first: f"{first}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"
    good, wrong = [ssn(f"{rnd.randint(1, 665):03d}") for _ in range(8)], [ssn(f"9{some(number, 2)}") for _ in range(4)] + [ssn("000"), ssn("666")]
    put("number", good, ("ssn", "social security number", "tax id:", "his social is", "national id"), ("", "on file"), 1)
    put("number", good, ("part", "serial", "order", "we saw", "", "isbn"), ("", "on file"), 0)
    put("number", wrong, ("ssn", "part", "", "tax id:"), ("", "on file"), 0)

    day = lambda year: rnd.choice(("{y}-{m:02d}-{d:02d}", "{d:02d}/{m:02d}/{y}", "{d}.{m}.{y}")).format(y=year, m=rnd.randint(1, 12), d=rnd.randint(1, 28))
    dates = [day(rnd.randint(1930, 2015)) for _ in range(10)]
    put("born", dates, ("born on", "date of birth:", "dob", "she was born", "birthday:"), ("", "in town"), 1)
    put("born", dates, ("born late. invoice of", "birth of a nation, seen", "dob or not, published", "a birth rate that fell in", "born free, version"), ("", "again"), 0)

    roads = [f"{rnd.randint(1, 9999)} {name} {kind}" for name in ("Oak", "Maple Hill", "King", "Lake View", "Second", "Mill") for kind in ("Street", "Ave", "Road", "Lane")]
    put("street", roads, ("lives at", "my address is", "ship to", "home:", "reside at"), ("", "today"), 1)
    put("street", roads, ("we saw", "a film called", "the song"), ("",), 0)

    persons = ("Ana Moreau", "Kim Larsen", "Jo Abbott", "Lea Fischer", "Omar Haddad", "Ines Duarte", "Mark Owen Hale")
    put("called", persons, ("my name is", "name:", "signed,", "patient", "Patient name:"), ("", "and"), 1)
    put("called", persons, ("we met Mr", "said Dr", "Frau", "Herr"), ("", "then"), 0)
    put("called", ("The", "And", "It"), ("brand name:", "file name:", "signed"), ("is", "was"), 0)
    rnd.shuffle(rows)
    return rows


def _features(spark: SparkSession, rows) -> list[tuple[str, list[float], int]]:
    """Features of a small labelled table; its size is bounded by the caller."""
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "i int, t string").coalesce(1)
    found = df.select("i", F.explode(candidates(F.col("t"))).alias("c")).select("i", "c.g", "c.x").collect()
    return [(r.g, list(r.x), rows[r.i][2]) for r in sorted(found, key=lambda r: (r.i, r.g)) if r.g == rows[r.i][0]]


def boost(rows: list[tuple[list[float], int]], rounds: int = 12, rate: float = 0.6, depth: int = 3) -> list:
    """Gradient boosting of logistic loss with regression trees: [(feature, border, low, high) or a value]."""
    z, trees = [0.0] * len(rows), []

    def fit(idx, g, h, d):
        sg, sh = sum(g[i] for i in idx), sum(h[i] for i in idx)
        best = None
        if d:
            for f in range(len(rows[0][0])):
                order = sorted(idx, key=lambda i: rows[i][0][f])
                lg = lh = 0.0
                for a, b in zip(order, order[1:], strict=False):
                    lg, lh = lg + g[a], lh + h[a]
                    if rows[a][0][f] < rows[b][0][f]:
                        gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, (rows[a][0][f] + rows[b][0][f]) / 2)
        if not best:
            return rate * sg / (sh + 1)
        _, f, border = best
        return f, border, fit([i for i in idx if rows[i][0][f] <= border], g, h, d - 1), fit([i for i in idx if rows[i][0][f] > border], g, h, d - 1)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-v)) for v in z]
        tree = fit(list(range(len(rows))), [y - q for (_, y), q in zip(rows, p, strict=True)], [q * (1 - q) for q in p], depth)
        trees.append(tree)
        z = [v + value(tree, x) for v, (x, _) in zip(z, rows, strict=True)]
    return trees


def value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def compiled(tree, x: Column) -> Column:
    """A tree as a CASE expression over the array of features."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, border, low, high = tree
    return F.when(F.get(x, F.lit(f)) <= border, compiled(low, x)).otherwise(compiled(high, x))


_models: dict = {}


def score(trees, x) -> float:
    return sum(value(t, x) for t in trees)


def border_of(rows: list[tuple[float, int]], precision: float = 0.97) -> float:
    """The lowest score from which on that share of the rows is personal; between two scores, in their middle."""
    ordered, right, best = sorted(rows, reverse=True), 0, None
    for k, (_, y) in enumerate(ordered, 1):
        right += y
        if right >= precision * k and (k == len(ordered) or ordered[k][0] < ordered[k - 1][0]):
            best = k
    if best is None:
        return math.inf
    return (ordered[best - 1][0] + ordered[best][0]) / 2 if best < len(ordered) else ordered[-1][0] - 1e-6


def model(spark: SparkSession) -> dict:
    """generator -> (trees, threshold, recall and precision on held-out rows); fitted once a process, since the table is fixed.

    Trees see half of the labelled rows, the threshold comes from a quarter, the figures from the last.
    """
    if not _models:
        rows = _features(spark, labelled())
        for g in CANDIDATES:
            own = [(x, y) for n, x, y in rows if n == g]
            grown, tuned, held = own[::2], own[1::4], own[3::4]
            trees = boost(grown)
            border = border_of([(score(trees, x), y) for x, y in tuned])
            said = [(score(trees, x) > border, y) for x, y in held]
            hits = sum(1 for p, y in said if p and y)
            figures = hits / max(1, sum(y for _, y in said)), hits / max(1, sum(p for p, _ in said))
            _models[g] = (trees, border, figures)
    return _models


def _best(chosen: Column) -> Column:
    """Of candidates that overlap the one with the best margin stays (ties: the earlier, then the longer one).

    What overlaps, directly or through others, is one chain; a chain is settled from its best candidate down.
    """
    none = F.array().cast(SCORED)
    start = F.struct(F.lit(-1).alias("end"), none.alias("chain"), F.array().cast(f"array<{SCORED}>").alias("all"))

    def link(a, c):
        more = F.struct(F.greatest(a["end"], c["e"]).alias("end"), F.concat(a["chain"], F.array(c)).alias("chain"), a["all"].alias("all"))
        new = F.struct(c["e"].alias("end"), F.array(c).alias("chain"), F.concat(a["all"], F.array(a["chain"])).alias("all"))
        return F.when(c["s"] < a["end"], more).otherwise(new)

    def settle(chain):
        rank = F.array_sort(F.transform(chain, lambda c: F.struct((-c["m"]).alias("r"), c["s"].alias("s"), (-c["e"]).alias("back"), c.alias("c"))))
        free = lambda kept, c: F.forall(kept, lambda o: (o["e"] <= c["s"]) | (c["e"] <= o["s"]))
        return F.aggregate(rank, none, lambda kept, r: F.when(free(kept, r["c"]), F.concat(kept, F.array(r["c"]))).otherwise(kept))

    ordered = F.array_sort(F.transform(chosen, lambda c: F.struct(c["s"].alias("s"), c.alias("c"))))
    chains = F.aggregate(F.transform(ordered, lambda x: x["c"]), start, link, lambda a: F.concat(a["all"], F.array(a["chain"])))
    return F.flatten(F.transform(chains, lambda c: F.when(F.size(c) > 1, settle(c)).otherwise(c)))


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base` and `added`: arrays of (kind, s, e), each in the order of kinds, then starts.

    Of candidates that overlap each other the one with the best margin stays; any that overlaps a base span gives way to it.
    Null and empty texts have no spans; repeated rows stay. Columns of `docs` named base or added give way.
    """
    fitted = model(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    named = lambda k: F.transform(base_spans(body, k), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    def scored(c):
        m = F.lit(-1.0)
        for g, (trees, border, _) in fitted.items():
            total = sum((compiled(t, c["x"]) for t in trees[1:]), compiled(trees[0], c["x"]))
            m = F.when(c["g"] == g, total - F.lit(border)).otherwise(m)
        return F.struct(m.alias("m"), c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))

    none = F.array().cast(SCORED)
    chosen = lambda cs: F.when(F.size(cs) > 0, F.filter(F.transform(cs, scored), lambda c: c["m"] > 0)).otherwise(none)
    rest = [c for c in docs.columns if c not in ("base", "added")]
    x = docs.select(*rest, F.concat(*map(named, BASE)).alias("base"), let(candidates(body), chosen).alias("added"))
    apart = lambda a, b: (a["e"] <= b["s"]) | (b["e"] <= a["s"])
    free = F.filter("added", lambda c: F.forall("base", lambda b: apart(b, c)))
    clean = let(free, lambda cs: F.when(F.size(cs) > 1, _best(cs)).otherwise(cs))
    bare = F.transform(clean, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return x.withColumn("added", F.when(F.size("added") > 0, ordered(bare)).otherwise(F.array().cast("array<struct<kind:string,s:int,e:int>>")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def ordered(spans: Column) -> Column:
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(rank(x).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def digest(rows: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans and their number, from what `found` returns."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = written(ordered(F.concat("base", "added"))).alias("spans")
    n_spans = (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    return rows.select("doc_id", *map(count, BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), every, n_spans)


def redacted(rows: DataFrame, text: str = "text") -> DataFrame:
    """The texts of what `found` returns, with each span replaced by its kind in brackets; base and added are dropped."""
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, x["s"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))).alias("out"))
    whole = F.aggregate(spans, start, cut, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.lit(2**31 - 1))))
    return rows.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop("base", "added")
