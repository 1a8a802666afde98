"""N-gram Jaccard join: exact, by rarity prefixes with set relations that skip work.

A set is the distinct word shingles of a text. Equal sets are one class from the start, so copies cost nothing.

1. Tokens meet by value: every task sends its tokens to the partition of their range, packed, and gets back only those that
   more than one set holds, with how many do. A token that a set alone holds can't be in an overlap, so a set whose shared
   tokens fall short of the threshold is out, and the overlap of two sets is that of their shared tokens. Heavy tokens, those
   that a large share of all sets holds, don't meet: tasks count the tokens of `TOKENS_COUNTED` at a time, and what is
   frequent in the corpus is frequent in some of these lots. So the heavy ones are known, are at most 2 * HEAVY whatever
   the corpus, and each set finds its own by looking them up; no task gathers the sets of one.
2. Prefixes: tokens in order of how many sets hold them (own tokens first). Two sets at the threshold share one of the first
   n - ceil(t n) + 1; what is posted of those is (token, set, position, size).
3. Set relations. Round 1 verifies each set against one candidate only: the one met most often among the smallest of its
   lists. A set at the threshold becomes a member of that one's family, with its distance to it. Lists are then read a family
   at a time, not a set at a time, and a family's answers follow from its centre's. Two bounds skip pairs. The distance
   1 - J obeys the triangle inequality: with d between two centres and a, b the distances of two members to theirs, the
   members are at least d - a - b apart. And a token that two members share lies in both centres, or in what one of the two
   shares outside its centre, so their overlap is at most the centres' plus those two counts. Whole pairs of families are
   skipped by their largest such numbers; else centres against members, then members against members, each time only those
   that the bounds leave and that aren't connected yet.
   Lists are skipped by position in blocks: sets of a list lie in blocks of positions and of sizes, and a pair of blocks is
   skipped if even its largest size and smallest position can't reach the overlap.
4. Components of the links.

Nothing is capped: every pair at the threshold ends in one component. Tokens are told apart by 64 bits, and so are sets.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import join_split, kept, scratch, stored, tasks
from .texthash import shingles, signature, slices

#: Tokens of a partition where they meet, and that a task holds before it sends them on.
TOKENS_A_PARTITION = 1_500_000
TOKENS_HELD = 400_000
#: Tokens that a task counts at once to find heavy ones; a token of more than a share of 1 / HEAVY of all tokens is one.
TOKENS_COUNTED = 2_000_000
HEAVY = 1 << 18
#: No token is heavy that fewer sets hold.
LEAST_HEAVY = 64


def _frequent(tokens: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Tokens of a lot of sets that may be heavy, and how many of the sets hold them."""
    every = np.concatenate(tokens)
    token, count = np.unique(every, return_counts=True)
    often = count >= max(2, math.ceil(len(every) / (2 * HEAVY)))
    return token[often].tobytes(), count[often].astype("<i8").tobytes()


def documents_of(docs: DataFrame, words: int, text: str = "text", tie: Column | None = None) -> DataFrame:
    """(doc_id, n, node, tokens, counts): the size of a document's set and the hash that names the set.

    An empty set has no node. Rows with `tokens` are no documents: they hold tokens that were frequent in a lot of sets.
    With a tie, it comes last.
    """
    more = [] if tie is None else ["tie"]
    names = ["doc_id", "n", "node", "tokens", "counts", *more]
    none = pa.array([None], pa.int64())

    def lot(held):
        token, count = _frequent(held)
        if token:
            columns = [none, none, none, pa.array([token]), pa.array([count])]
            yield pa.RecordBatch.from_arrays([*columns, *(none for _ in more)], names=names)

    def sign(batches):
        seen, held, total = set(), [], 0
        for b in batches:
            for part in slices(b, "text"):
                sets = shingles(part["text"], words)
                nodes = [signature(s) if len(s) else None for s in sets]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                empty = pa.nulls(len(sets), pa.binary())
                columns = [part["doc_id"], sizes, pa.array(nodes, pa.int64()), empty, empty]
                yield pa.RecordBatch.from_arrays([*columns, *(part[c] for c in more)], names=names)
                for node, s in zip(nodes, sets, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        held.append(s)
                        total += len(s)
                if total >= TOKENS_COUNTED:
                    yield from lot(held)
                    seen, held, total = set(), [], 0
        if held:
            yield from lot(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), *(tie.alias(k) for k in more))
    schema = "doc_id long, n long, node long, tokens binary, counts binary" + "".join(f", {k} long" for k in more)
    return rows.mapInArrow(sign, schema)


def heavy_tokens(lots: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, kinds): the heavy tokens, ascending, and the class of how many sets hold them; at most 2 * HEAVY.

    A token in more than total / HEAVY sets is among them: in the lots where it wasn't frequent it has half of that at most.
    The counts of all tokens together don't exceed the total, which bounds how many reach the border.
    """

    def unpack(batches):
        for b in batches:
            token = np.frombuffer(b"".join(b["tokens"].to_pylist()), "<u8")
            count = np.frombuffer(b"".join(b["counts"].to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "c"])

    each = lots.select("tokens", "counts").mapInArrow(unpack, "token long, c long")
    border = max(LEAST_HEAVY, math.ceil(total / (2 * HEAVY)))
    found = each.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= border).toArrow()
    token = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], _kind(found["c"].to_numpy()[order])


def _kind(count: np.ndarray) -> np.ndarray:
    """The class of a token: the logarithm of the number of its sets, in eighths; ties in it are broken by the token."""
    return np.minimum(255, np.ceil(8 * np.log2(count))).astype(np.uint8)


def _is_heavy(tokens: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each token is heavy, its place among the heavy ones)."""
    if not len(heavy):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    return heavy[at] == tokens, at


def _lots(batches, words: int):
    """Lists of (node, set) of about TOKENS_HELD tokens, without repeated sets."""
    seen: set[int] = set()
    held, total = [], 0
    for b in batches:
        for piece in slices(b, "text"):
            for s in shingles(piece["text"], words):
                if len(s) and (node := signature(s)) not in seen:
                    seen.add(node)
                    held.append((node, s))
                    total += len(s)
            if total >= TOKENS_HELD:
                yield held
                seen, held, total = set(), [], 0
    if held:
        yield held


NAMES = ["part", "nodes", "sizes", "counts", "tokens"]
BACK = [*NAMES, "kinds"]
SENT = "part long, nodes binary, sizes binary, counts binary, tokens binary"


def _packed(rows: dict) -> pa.RecordBatch:
    """A batch of `part` and packed columns."""
    columns = [pa.array(x, pa.int64() if n == "part" else pa.binary()) for n, x in rows.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(rows))


def _base(part: int, parts: int) -> int:
    """The smallest token of a partition's range."""
    return -(-(part << 32) // parts) << 32


def _width(parts: int) -> int:
    """Bytes that tell all tokens of a partition apart: what lies above its smallest token."""
    return next(k for k in range(1, 9) if -(-(1 << 32) // parts) << 32 <= 1 << 8 * k)


def _dealt(held: list, parts: int, heavy: np.ndarray) -> pa.RecordBatch:
    """Rows (part, nodes, sizes, counts, tokens): the tokens of many sets that belong to one partition, set by set."""
    nodes = np.array([n for n, _ in held], np.int64)
    sizes = np.array([len(s) for _, s in held], np.int32)
    tokens = np.concatenate([s for _, s in held])
    of = np.repeat(np.arange(len(held)), sizes)
    meets = ~_is_heavy(tokens, heavy)[0]
    tokens, of = tokens[meets], of[meets]
    part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    # By partition, and in it by set: both are sorted already within a set.
    order = np.argsort(part, kind="stable")
    tokens, of, part = tokens[order], of[order], part[order]
    edges, width = np.searchsorted(part, np.arange(parts + 1)), _width(parts)
    rows = {n: [] for n in NAMES}
    for p in range(parts):
        i, j = edges[p], edges[p + 1]
        if i < j:
            own, counts = np.unique(of[i:j], return_counts=True)
            low = (tokens[i:j] - np.uint64(_base(p, parts))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            packed = (p, nodes[own].tobytes(), sizes[own].tobytes(), counts.astype(np.int32).tobytes(), low.tobytes())
            for n, x in zip(NAMES, packed, strict=True):
                rows[n].append(x)
    return _packed(rows)


def _returned(node: np.ndarray, size: np.ndarray, token: np.ndarray, kind: np.ndarray, parts: int) -> pa.RecordBatch:
    """Tokens on their way to where their sets are gathered, packed set by set."""
    to = ((node.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((node, to))
    token, node, size, kind, to = token[order], node[order], size[order], kind[order], to[order]
    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    out = {n: [] for n in BACK}
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        heads = i + np.flatnonzero(np.concatenate([[True], node[i + 1 : j] != node[i : j - 1]]))
        counts = np.diff(np.concatenate([heads, [j]])).astype(np.int32)
        packed = (to[i], *(x.tobytes() for x in (node[heads], size[heads], counts, token[i:j], kind[i:j])))
        for n, x in zip(BACK, packed, strict=True):
            out[n].append(x)
    return _packed(out)


def _meet(batches, parts: int):
    """Tokens of one partition that several sets hold, sent back. A heavy token isn't there, so no token has very many sets."""
    by_part: dict[int, list] = {}
    for b in batches:
        for r in range(b.num_rows):
            by_part.setdefault(b["part"][r].as_py(), []).append([b[c][r].as_py() for c in NAMES[1:]])
    width = _width(parts)
    for p in sorted(by_part):
        rows = deque(by_part.pop(p))
        of = lambda k: [np.repeat(np.frombuffer(r[k], (np.int64, np.int32)[k]), np.frombuffer(r[2], np.int32)) for r in rows]  # noqa: E731, B023
        node, size = np.concatenate(of(0)), np.concatenate(of(1))
        token = np.zeros((len(node), 8), np.uint8)
        at = 0
        while rows:
            raw = np.frombuffer(rows.popleft()[3], np.uint8).reshape(-1, width)
            token[at : at + len(raw), :width], at = raw, at + len(raw)
        token = token.view("<u8").ravel()
        token += np.uint64(_base(p, parts))
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        # A set may come from several tasks.
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, size = token[fresh], node[fresh], size[fresh]
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        held = np.diff(np.concatenate([heads, [len(token)]]))
        count = np.repeat(held, held)
        shared = count > 1
        if shared.any():
            yield _returned(node[shared], size[shared], token[shared], _kind(count[shared]), parts)


def needed(n, percent: int):
    """Tokens that a set of n shares at least with any set at the threshold."""
    return -(-n * percent // 100)


def shared_tokens(docs: DataFrame, total: int, heavy: tuple[np.ndarray, np.ndarray], words: int, percent: int, text: str = "text") -> DataFrame:
    """(node, n, tokens, post, first): sets that share enough tokens to reach the threshold with anything.

    tokens: their shared tokens, ascending; post: those of the prefix, first: the position of the first of them.
    """
    spark = docs.sparkSession
    parts = max(tasks(spark), -(-total // TOKENS_A_PARTITION))
    known = spark.sparkContext.broadcast(heavy)  # at most 2 * HEAVY tokens

    def send(batches):
        for held in _lots(batches, words):
            yield _dealt(held, parts, known.value[0])

    def look_up(batches):
        tokens, kinds = known.value
        for held in _lots(batches, words):
            sizes = np.array([len(s) for _, s in held], np.int32)
            every = np.concatenate([s for _, s in held])
            own, at = _is_heavy(every, tokens)
            if own.any():
                node = np.repeat(np.array([n for n, _ in held], np.int64), sizes)[own]
                yield _returned(node, np.repeat(sizes, sizes)[own], every[own], kinds[at[own]], parts)

    def order(batches):
        rows = [[b[c][r].as_py() for c in BACK[1:]] for b in batches for r in range(b.num_rows)]
        if not rows:
            return
        counts = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
        flat = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in rows])
        node, size = np.repeat(flat(0, np.int64), counts), np.repeat(flat(1, np.int32), counts)
        token, kind = flat(3, "<u8"), flat(4, np.uint8)
        del rows
        by = np.lexsort((token, node))
        node, size, token, kind = node[by], size[by], token[by], kind[by]
        # Several tasks look up the heavy tokens of sets that several texts have.
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        node, size, token, kind = node[fresh], size[fresh], token[fresh], kind[fresh]
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64())
        out = []
        for i, j in zip(heads, [*heads[1:], len(node)], strict=True):
            n = int(size[i])
            if j - i >= needed(n, percent):
                own, prefix = n - (j - i), n - needed(n, percent) + 1
                rare = np.lexsort((token[i:j], kind[i:j]))[: max(0, prefix - own)]
                out.append((int(node[i]), n, token[i:j].tobytes(), token[i:j][rare].astype(np.int64), int(own)))
            if len(out) >= 1000 or j == len(node) and out:
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "tokens", "post", "first"])
                out = []

    texts = docs.select(F.col(text).alias("text"))
    met = texts.mapInArrow(send, SENT).repartitionById(parts, F.col("part").cast("int"))
    back = met.mapInArrow(lambda batches: _meet(batches, parts), f"{SENT}, kinds binary")
    if len(heavy[0]):
        back = back.unionByName(texts.mapInArrow(look_up, f"{SENT}, kinds binary"))
    gathered = back.repartitionById(parts, F.col("part").cast("int"))
    return gathered.mapInArrow(order, "node long, n long, tokens binary, post array<long>, first long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y, inter, nx, ny, linked) for (x, y): exact overlaps. Hot sets are on the side of the join that can be split."""
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    fed = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "nx", "ny", "tx", "ty")

    def overlap(batches):
        for b in batches:
            both = zip(b["tx"].to_pylist(), b["ty"].to_pylist(), strict=True)
            sets_ = ((np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")) for s, t in both)
            inter = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in sets_]
            columns = [b["x"], b["y"], pa.array(inter, pa.int64()), b["nx"], b["ny"]]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "inter", "nx", "ny"])

    done = fed.mapInArrow(overlap, "x long, y long, inter long, nx long, ny long")
    return done.withColumn("linked", F.col("inter") * 100 >= (F.col("nx") + F.col("ny") - F.col("inter")) * percent)


def distance(inter, nx, ny):
    return 1.0 - inter / (nx + ny - inter)


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what the links of all pairs connect."""
    far = 1 - percent / 100 + 1e-9  # distance of the threshold, with room for rounding; decisions are by integers
    posted = sets.where(F.size("post") > 0).select("node", "n", "first", F.posexplode("post").alias("k", "token"))
    posted = posted.select("token", "node", "n", "first", (F.col("first") + F.col("k")).alias("pos"))
    posted = stored(posted)
    # The centre of a list is its set with the fewest tokens of its own: of a text and its edited copies, that is the text.
    lists = posted.groupBy("token").agg(F.min(F.struct("first", "node")).alias("m"), F.count("*").alias("c"))
    lists = lists.where("c > 1").select("token", F.col("m.node").alias("y"))

    # Round 1: one candidate for each set.
    met = posted.join(lists, "token").where("node != y")
    met = met.groupBy(F.col("node").alias("x"), "y").agg(F.count("*").alias("c"))
    best = met.groupBy("x").agg(F.max(F.struct("c", F.bitwise_not("y").alias("y"))).alias("m"))
    best = best.select("x", F.bitwise_not("m.y").alias("y"))
    own = sets.select(F.col("node").alias("x"), F.col("first").alias("own"))
    linked = verified(best, sets, percent).where("linked").join(own, "x")
    apart_by = distance(F.col("inter"), F.col("nx"), F.col("ny")).alias("d")
    outside = (F.col("nx") - F.col("own") - F.col("inter")).alias("e")
    first = stored(linked.select("x", "y", apart_by, outside))
    roots = stored(components(first.select(F.col("x").alias("a"), F.col("y").alias("b"))))

    # What is left: lists whose sets aren't connected yet.
    # e: tokens that a member shares with anything but its centre.
    member = first.select(F.col("x").alias("node"), F.col("y").alias("fam"), F.col("d").alias("a"), "e")
    state = sets.select("node", "n", (F.col("n") - F.col("first")).alias("m")).join(member, "node", "left").join(roots, "node", "left")
    known = (F.coalesce("fam", "node").alias("fam"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("e", F.lit(0)).alias("e"))
    state = stored(state.select("node", "n", "m", *known, F.coalesce("root", "node").alias("root")))
    at = posted.join(state.drop("n", "m"), "node")
    open_ = at.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_ = open_.where("lo != hi").select("token")
    # A family in a list, by blocks of size (in powers of the threshold) and of what follows the position.
    step = float(np.log(100 / percent))
    block = at.join(open_, "token").withColumn("band", F.floor(F.log("n") / step)).groupBy("token", "fam", "root", "band")
    block = block.agg(F.max(F.col("n") - F.col("pos")).alias("left"), F.max("n").alias("top"), F.min("n").alias("low"))
    left, right = block.alias("l"), block.alias("r")
    near = F.col("l.top") * 100 >= F.col("r.low") * percent
    need = (F.col("l.low") + F.col("r.low")) * percent / (100 + percent)
    reach = (F.col("l.left") >= need - 1e-6) & (F.col("r.left") >= need - 1e-6)
    bands = left.withColumn("to", F.explode(F.array(F.col("l.band"), F.col("l.band") + 1))).alias("l")
    on = (F.col("l.token") == F.col("r.token")) & (F.col("l.to") == F.col("r.band")) & (F.col("l.root") != F.col("r.root"))
    pairs = bands.join(right, on).where(near & reach)
    pairs = pairs.select(F.least("l.fam", "r.fam").alias("x"), F.greatest("l.fam", "r.fam").alias("y")).distinct()
    pairs = stored(pairs)
    centre = verified(pairs.where("x != y"), sets, percent)
    # A set has itself for a centre, too, so that a family's bounds hold for its centre.
    own = state.select(F.col("node").alias("fam"), F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("e"), "n")
    family = state.select("fam", "a", "e", "n").unionByName(own)
    family = family.groupBy("fam").agg(F.max("a").alias("r"), F.max("e").alias("e"), F.min("n").alias("low"))
    side = lambda c: family.select(F.col("fam").alias(c), *(F.col(k).alias(k + c) for k in ("r", "e", "low")))
    centre = centre.join(side("x"), "x").join(side("y"), "y")
    # Integers at the threshold decide whether two centres link; the bounds only skip.
    centre = centre.withColumn("d", distance(F.col("inter"), F.col("nx"), F.col("ny")))
    centre = centre.where(f"linked OR (d <= {far} + rx + ry AND {reaches('inter + ex + ey', 'lowx + lowy', percent)})")
    centre = stored(centre.select("x", "y", "linked", "inter", "d", "rx", "ry", "ex", "ey", "lowx", "lowy"))
    edge = (F.col("x").alias("a"), F.col("y").alias("b"))
    edges = first.select(*edge).unionByName(centre.where("linked").select(*edge))
    # Families that are connected by now are done: their members are connected to their centres.
    roots = stored(components(edges))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"o{c}"))
    apart = centre.where("NOT linked").join(of("x"), "x", "left").join(of("y"), "y", "left")
    apart = apart.where("coalesce(ox, x) != coalesce(oy, y)")
    border = stored(apart.drop("linked", "ox", "oy"))
    if border.isEmpty():
        return edges

    # Centres against members, then members against members: only what the bounds leave and what isn't connected.
    rooted_ = lambda r: stored(state.drop("root").join(r, "node", "left").select("node", "n", "m", "fam", "a", "e", F.coalesce("root", "node").alias("root")))
    now = rooted_(roots)
    swap = {"x": "y", "y": "x", "rx": "ry", "ry": "rx", "ex": "ey", "ey": "ex", "lowx": "lowy", "lowy": "lowx"}
    turned = border.unionByName(border.select(*(F.col(c).alias(swap.get(c, c)) for c in border.columns)))
    inside = now.select(F.col("fam").alias("x"), F.col("node").alias("u"), F.col("n").alias("nu"), F.col("m").alias("mu"), "a", "e", "root")
    inside = inside.where("u != x")
    ends = now.select(F.col("node").alias("y"), F.col("root").alias("oy"), F.col("m").alias("my"))
    # In the centre a member and y share no more than either shares with it; outside, no more than either has there.
    most = "least(inter, mu - e) + least(e, my - inter) + ey"
    bound = f"root != oy AND a + ry >= d - {far} AND {reaches(most, 'nu + lowy', percent)}"
    ask = stored(turned.join(ends, "y").join(inside, "x").where(bound).select(F.col("u").alias("x"), "y").distinct())
    asked = stored(verified(ask, sets, percent).select("x", "y", "linked", "inter", apart_by))
    edges = stored(edges.unionByName(asked.where("linked").select(*edge)))

    roots = stored(components(edges))
    now = rooted_(roots)
    one = now.select(F.col("fam").alias("x"), F.col("node").alias("u"), F.col("n").alias("nu"), F.col("e").alias("eu"), F.col("root").alias("ou"))
    # What is known of a member and the other centre: the centre's own overlap if it is the centre, else what was asked.
    sized = now.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ou"))
    of_centre = turned.select("x", "y", F.col("x").alias("u"), "inter", "d", F.col("inter").alias("between")).join(sized, "u")
    of_centre = of_centre.select("x", "y", "u", "inter", "d", "between", "nu", F.lit(0).cast("long").alias("eu"), "ou")
    between = turned.select("x", "y", F.col("inter").alias("between"))
    of_member = asked.select(F.col("x").alias("u"), "y", "inter", "d").join(one, "u").join(between, ["x", "y"]).select(of_centre.columns)
    names = {"fam": "y", "node": "v", "n": "nv", "a": "av", "e": "ev", "root": "ov"}
    other = now.select(*(F.col(c).alias(name) for c, name in names.items()))
    bound = f"ou != ov AND u != v AND av >= d - {far} AND {reaches('inter + ev', 'nu + nv', percent)}"
    bound += f" AND {reaches('between + eu + ev', 'nu + nv', percent)}"
    two = of_centre.unionByName(of_member).join(other, "y").where(bound)
    two = stored(two.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct())
    return edges.unionByName(verified(two, sets, percent).where("linked").select(*edge))


def reaches(overlap: str, sizes: str, percent: int) -> str:
    """SQL: whether an overlap, or a bound of it, reaches the threshold for two sets of `sizes` tokens together."""
    return f"({overlap}) * {100 + percent} >= ({sizes}) * {percent}"


def rooted(docs: DataFrame, words: int, percent: int, text: str, tie: Column | None = None) -> tuple[DataFrame, int, DataFrame]:
    """The documents of documents_of, how many they are, and (node, root) of the sets that have links."""
    rows = kept(documents_of(docs, words, text, tie))
    every = rows.where("tokens IS NULL").drop("tokens", "counts")
    total, n = every.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return every, n, every.select("node", F.col("node").alias("root")).limit(0)
    heavy = heavy_tokens(rows.where("tokens IS NOT NULL"), total)
    sets = stored(shared_tokens(docs, total, heavy, words, percent, text))
    return every, n, kept(components(links(sets, percent)))


def joined(docs: DataFrame, words: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), class_id.

    Null and empty texts have empty sets and stand alone. class_id is the smallest doc_id with the same set. Rows that
    share a doc_id each get their own; null doc_ids take part in links but name no class.
    """
    with scratch(docs.sparkSession):
        every, n, found = rooted(docs, words, percent, text)
        classes = every.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("docs"))
        # A set without links is its own root. What is joined by root are the others only, which may have a root in common.
        named = stored(classes.join(found, "node", "left"))
        linked = named.where("root IS NOT NULL")
        least = stored(linked.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("c")))
        columns = ["node", "class_id", "component_id", "docs"]
        alone = named.where("root IS NULL").withColumn("component_id", F.col("class_id")).select(*columns)
        labelled = kept(join_split(linked, least, ["root"], "c", n).select(*columns).unionByName(alone))
    one = every.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    more = join_split(every.where("node IS NOT NULL"), labelled, ["node"], "docs", n)
    return more.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id").unionByName(one)


def representatives(docs: DataFrame, words: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id, then the smallest hash of the row. Rows without words stay.

    A null doc_id comes after all others. Rows are told apart by doc_id and hash, so those that share a doc_id, or have
    none, stand for their own components; of wholly equal rows one stays.
    """
    tie = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))
    with scratch(docs.sparkSession):
        every, _, found = rooted(docs, words, percent, text, tie)
        row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
        least = every.where("node IS NOT NULL").groupBy("node").agg(row.alias("m")).join(found, "node", "left")
        least = least.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("m").alias("m"))
        keep = least.select(F.col("m.doc_id").alias("_id"), F.col("m.tie").alias("_tie"), F.lit(False).alias("_alone"))
        bare = every.where("node IS NULL").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.lit(True).alias("_alone"))
        keep = kept(keep.unionByName(bare.distinct()))
    whole = F.struct(*(F.col(c) for c in docs.columns))
    rows = docs.select(whole.alias("_doc"), F.col("doc_id").cast("long").alias("_of"), tie.alias("_row"))
    rows = rows.join(keep, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_tie")))
    once = F.when(F.col("_alone"), F.monotonically_increasing_id())
    return rows.withColumn("_once", once).dropDuplicates(["_id", "_tie", "_once"]).select("_doc.*")
