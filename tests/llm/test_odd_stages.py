"""Pipeline stages with nulls, ties, repeated rows, empty tables and columns that clash."""

import pytest

import corpus_pipeline as p

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, row string, doc string, _size int, _text string"


def say(mark, n=60):
    return " ".join(f"{mark}word{k}" for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, say("a")), (1, say("b")), (None, say("c")), (None, say("d")), (2, say("a") + " more"), (3, None), (4, ""), (5, " \n\t"), (6, say("e")), (6, say("e")), (7, "x " * 3000), (8, say("f", 400))]
    rows = [(i, t, "en", None if i == 8 else "s", len(t or ""), 1, "s", "r", "d", 2, "t") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages(spark, docs):
    kept = p.quality_rules(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    # Null, empty and blank texts have too few words; the text of one word repeats itself.
    assert texts(kept) == sorted([("1", say("a")), ("1", say("b")), ("None", say("c")), ("None", say("d")), ("2", say("a") + " more"), ("6", say("e")), ("6", say("e")), ("8", say("f", 400))])
    one = p.near_duplicates(spark, docs, SF_DIR)
    assert one.columns == docs.columns
    want = [("1", say("a")), ("1", say("b")), ("None", say("c")), ("None", say("d")), ("3", ""), ("4", ""), ("5", " \n\t"), ("6", say("e")), ("7", "x " * 3000), ("8", say("f", 400))]
    assert texts(one) == sorted(want)
    clean = p.decontamination(spark, docs, SF_DIR)
    assert clean.columns == docs.columns and texts(clean) == texts(docs)
    mixed = p.mixing(spark, docs, SF_DIR)
    assert mixed.columns == docs.columns
    assert all(r.text and r.n_words == 1 and r.row == "r" for r in mixed.collect())
    ids = p.token_ids(spark, docs, SF_DIR)
    assert ids.count() == docs.count() and ids.where("doc_id = 3").first().n_tokens == 1


def test_no_rows(spark, docs):
    none = docs.where("doc_id > 99")
    for _, stage in p.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0
