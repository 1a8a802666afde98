"""One row of each component stays, whatever its doc_id."""

from quietline.llm import ngram_join


def test_representatives_without_or_with_repeated_ids(spark):
    say = lambda mark: " ".join(f"{mark}{i}" for i in range(40))
    near = say("a") + " z"
    rows = [(None, say("n1")), (None, say("n2")), (None, say("n2")), (None, say("n3")), (5, say("x")), (5, say("y")), (1, say("a")), (7, near), (7, say("b")), (None, near), (None, ""), (None, ""), (8, None)]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert kept.columns == ["doc_id", "text"]
    want = [(None, say("n1")), (None, say("n2")), (None, say("n3")), (5, say("x")), (5, say("y")), (1, say("a")), (7, say("b")), (None, ""), (None, ""), (8, None)]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
