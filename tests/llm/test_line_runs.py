"""Repeated runs of lines go to their ends."""

import random

from quietline.llm import linededup


def gone(texts, least):
    """Lines of runs of `least` words that occur earlier, but for those of the earliest occurrence; by brute force over all runs."""
    lines = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    first, out = {}, set()
    for i in range(len(lines)):
        n, run = 0, ()
        for j in range(i, len(lines)):
            if lines[j][0] != lines[i][0]:
                break
            run, n = (*run, lines[j][2]), n + len(lines[j][2].split())
            if n >= least:
                at = first.setdefault(run, i)
                stay = {x[:2] for x in lines[at : at + len(run)]}
                out |= {x[:2] for x in lines[i : j + 1]} - stay if at != i else set()
    return out


def test_line_runs_to_their_ends(spark):
    rnd = random.Random(5)
    pool = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefghijkl", (1, 2, 3, 4, 5, 8, 9, 3, 6, 2, 7, 4))]
    texts = []
    for _ in range(40):
        part = [rnd.choice(pool) for _ in range(rnd.randrange(2, 9))]
        texts.append("\n".join([f"x{rnd.random()}", *part, f"y{rnd.random()}", *(part * rnd.randrange(3))]))
        texts.append("\n".join([rnd.choice(pool), *(texts[rnd.randrange(len(texts))].split("\n")[1:-1]), rnd.choice(pool)]))
    texts.append("\n".join(["z z"] * 60))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = linededup.removed(linededup.numbered(docs), 12).collect()
    assert {(r.doc_id.id, k) for r in rows for x in r.runs for k in range(x.start, x.end + 1)} == gone(texts, 12)


def test_passage_with_short_last_lines(spark):
    passage = "\n".join(" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 60), ("q", 5), ("r", 8)))
    docs = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}[2] == "c\nd"


def test_rows_that_share_an_id(spark):
    """Equal rows, and rows of one id with other texts, are texts of their own: each repeat goes, and its first occurrence stays."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) + "\n" + " ".join(f"{c}{i}" for i in range(60, 120)) for c in "ab")
    rows = [(1, a), (1, a), (1, a), (2, b), (2, "x\n" + a), (None, a), (3, b + "\ny"), (4, None), (4, "")]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    kept = sorted((str(r.doc_id), r.text or "") for r in got)
    assert kept == sorted([("1", a), ("1", ""), ("1", ""), ("2", b), ("2", "x"), ("None", a), ("3", "y"), ("4", ""), ("4", "")])


def test_random_rows_that_share_ids(spark):
    rnd = random.Random(9)
    pool = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefgh", (4, 5, 8, 9, 3, 6, 7, 4))]
    rows = [(rnd.randrange(9), "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 7)))) for _ in range(60)]
    rows.sort(key=lambda r: r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    numbered = linededup.numbered(docs)
    at = {r.key.row: k for k, r in enumerate(numbered.orderBy("key.row").collect())}
    got = {(at[r.doc_id.row], k) for r in linededup.removed(numbered, 12).collect() for x in r.runs for k in range(x.start, x.end + 1)}
    assert got == gone([t for _, t in rows], 12)
