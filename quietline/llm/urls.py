"""URL filters: rules for hosts and paths, and a logistic regression over hashed character n-grams for what no rule settles.

The model is fitted on the driver from a small labelled table (`LABELLED`, at most `MOST_LABELLED` rows); its weights, 2**16
numbers at most, go to the tasks with the function.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SIZES = 16, (3, 4, 5, 6)
#: Rows of a labelled table that are used at most.
MOST_LABELLED = 5000

#: Words of hosts and paths that stand for unwanted sites, and for others; the labelled table is put together from them.
UNWANTED = (
    "casino poker roulette slots blackjack gambling bet bets betting bookmaker sportsbook lottery jackpot bingo wager "
    "viagra cialis levitra pills pharma rx steroids weightloss diet detox "
    "porn xxx sex nude naked adult escort escorts camgirls webcam hookup fetish milf hentai "
    "loan loans payday credit-repair forex binary-options giveaway getrich quick-cash "
    "warez crack cracked keygen serials nulled torrent torrents free-download "
    "phishing verify-account login-secure account-update win-prize free-gift claim-now "
    "replica fake-id spam spammer linkfarm backlinks buy-followers buy-likes clickbait "
    "adserver adclick popunder tracker tracking pixel banners affiliate doorway sponsor-links cheap discount-meds"
).split()
WANTED = (
    "news blog docs wiki library museum school college university science history garden recipes travel weather sports music art "
    "health clinic hospital city council county journal archive forum support photo maps books cinema theatre market bakery hotel "
    "bridge river mountain lake forest harbour research engineering physics biology chemistry medicine economy politics culture "
    "home world data open project community church charity radio tv magazine times post herald tribune gazette daily review "
    "software developer linux python code package api status help learn course student teacher children family farm kitchen "
    "coffee tea bread wine fish bird horse dog cat tree flower stone paper glass wood iron silver north south east west green "
    "blue red white old new first second law court justice police fire rescue army navy bank post-office insurance railway bus "
    "airport bicycle car truck energy solar wind water metal chemical studio gallery design print fashion shoes shop store"
).split()


@dataclass(frozen=True)
class Rule:
    """A rule fits `host` and all its subdomains if the path starts with `path`. The longest rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, unwanted 0/1): words in the places that they take in addresses, on hosts under many suffixes."""
    tails, names = ("com", "org", "net", "info", "co.uk", "de", "fr", "io"), ("www", "m", "shop", "my")
    rows = []
    for words, label in ((UNWANTED, 1), (WANTED, 0)):
        for i, w in enumerate(words):
            tail, other, name = tails[i % len(tails)], words[(i * 7 + 3) % len(words)], names[i % len(names)]
            rows += [
                (f"{w}.{tail}", "/", label),
                (f"{name}.{w}{i % 90}.{tail}", f"/{other}/{i * 37 % 1000}", label),
                (f"{w}-{other}.{tail}", f"/p/{i}.html", label),
                (f"{other}{w}.{tail}", "/index.php", label),
            ]
            if label:  # on a host that says nothing, and between words of others
                plain = WANTED[i * 3 % len(WANTED)]
                rows += [(f"site{i}.{tail}", f"/{w}/{other}", 1), (f"{plain}-{w}.{tail}", "/", 1), (f"{name}.{w}-{plain}.host{i % 9}.{tail}", "/en/", 1)]
            else:
                rows += [(f"{name}.{w}{other}.{tail}", f"/{i % 28 + 1:02d}/{w}-and-{other}", 0), (f"{other}.host{i % 9}.{tail}", f"/en/{w}", 0)]
    return rows


def grams(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, which are kept apart."""
    out = set()
    for mark, x in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = x.encode()
        for n in SIZES:
            out.update(zlib.crc32(raw[k : k + n], ord(mark)) & ((1 << BITS) - 1) for k in range(len(raw) - n + 1))
    return np.fromiter(out, np.int32, len(out))


@functools.cache
def fitted(rows: tuple | None = None, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, intercept); full-batch gradient descent from zero, so every fit of the same table is the same."""
    table = list(rows or labelled())[:MOST_LABELLED]
    each, y = [grams(h, p) for h, p, _ in table], np.array([t[2] for t in table], float)
    of, col = np.repeat(np.arange(len(each)), [len(e) for e in each]), np.concatenate(each)
    scale = 1 / np.sqrt(np.array([len(e) for e in each]))
    w, b, weight = np.zeros(1 << BITS), 0.0, np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(of, w[col], len(each)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) * weight
        w -= rate * 40 * (np.bincount(col, (g * scale)[of], 1 << BITS) + decay * w / 40)
        b -= rate * g.sum()
    return w, b


def score(host: str, path: str, model) -> float:
    g = grams(host, path)
    return float(model[0][g].sum() / np.sqrt(len(g)) + model[1]) if len(g) else float(model[1])


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. A url without `://` has neither."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    clean = lambda c: F.coalesce(c, F.lit(""))
    return F.translate(clean(host), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), clean(path)


def judged(pages: DataFrame, rules=RULES, rows=None, threshold: float = 0.0, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and score; columns of `pages` with these names give way.

    Verdicts: the longest rule's, else block where the model's score exceeds the threshold. Null urls and such without `://`
    have an empty host and path and are allowed.
    """
    model = fitted(tuple(rows) if rows else None)
    host, path = parts(F.col(url))
    new = ("host", "path", "rule", "verdict", "score")
    x = pages.select(*(c for c in pages.columns if c not in new), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    x = x.withColumns({"rule": rule, "verdict": verdict, "score": F.lit(0.0)})

    def apply(batches):
        for b in batches:
            s = [score(h, p, model) if h else 0.0 for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            v = [old or ("block" if h and k > threshold else "allow") for old, h, k in zip(b["verdict"].to_pylist(), b["host"].to_pylist(), s, strict=True)]
            keep = {"score": pa.array(s, pa.float64()), "verdict": pa.array(v, pa.string())}
            yield pa.RecordBatch.from_arrays([keep.get(c, b.column(k)) for k, c in enumerate(b.schema.names)], names=b.schema.names)

    return x.mapInArrow(apply, x.schema)
