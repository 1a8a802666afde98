"""The masked model learns, covers every word, and doesn't follow the input's partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietline.llm import masked_lm as m
from quietline.llm.texthash import words_and_endings


def test_every_word_is_a_target_once():
    counts = np.array([0, 4000, 1, 999])
    turns = m.turns(np.arange(4, dtype=np.uint64), counts, 3)
    assert set(turns.tolist()) == {0, 1, 2} and len(turns) == counts.sum()
    assert min(np.bincount(turns.astype(int))) > 1400 and m.ROUNDS > 1


def languages(n, seed):
    """Texts in two languages of 300 words each, with some words of their own."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        mark = rnd.choice("pq")
        out.append((k, " ".join([f"{mark}{int(rnd.paretovariate(0.6)) % 300}" for _ in range(rnd.randrange(30, 120))] + [f"own{seed}{k}"])))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([*languages(900, 1), (-1, None), (-2, ""), (-3, "zz yy")], "doc_id long, text string")


def test_held_out_documents_beat_single_words(spark, corpus):
    model = m.fitted(corpus)
    held = spark.createDataFrame(languages(150, 2), "doc_id long, text string")
    got = m.scored(held, model=model).agg(F.sum("log_likelihood"), F.sum("n_words")).first()
    # The best that a model of single words can say of these texts: each word's share of all, unseen ones counted once.
    n = {r.w: r.n for r in corpus.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    single = sum(math.log(n.get(w, 1) / total) for _, t in languages(150, 2) for w in t.split())
    assert got[0] / got[1] > single / got[1] + 0.2


def test_scores_are_sums_of_conditionals(spark, corpus):
    model = m.fitted(corpus, rounds=2, table=50)  # most rare words go through the joined table
    assert model.border > 1
    net, vocabulary = m.Network.of(model.flat), m.Vocabulary(model.known)
    n = {r.h: r.n for r in model.counts.collect()}
    rows = {r.doc_id: r for r in m.scored(corpus, model=model).collect()}
    for i, text in [*languages(900, 1)[:12], (-3, "zz yy")]:
        h, ending, _ = words_and_endings(m.pa.array([text]))
        ids, want = vocabulary.ids(h, ending).tolist(), 0.0
        for k, target in enumerate(ids):
            around = [ids[j] if 0 <= j < len(ids) else m.EDGE for j in (k - 2, k - 1, k + 1, k + 2)]
            hidden = np.tanh(sum(net.e[p][x] for p, x in enumerate(around)) + net.b)
            group = np.exp(hidden @ net.k + net.kb)
            every = np.concatenate([group[c] / group.sum() * np.exp(hidden @ net.o[c] + net.ob[c]) / np.exp(hidden @ net.o[c] + net.ob[c]).sum() for c in range(m.CLASSES)])
            assert abs(every.sum() - 1) < 1e-4
            rare = math.log(n[int(h[k].astype(np.int64))] / model.buckets[target - m.KNOWN]) if target >= m.KNOWN else 0.0
            want += math.log(every[target]) + rare
        assert abs(rows[i].log_likelihood - want) < 1e-3 * rows[i].n_words


def test_repartitioning_changes_nothing(corpus):
    one, many = ({r.doc_id: r.mean_log for r in m.scored(d).collect()} for d in (corpus.coalesce(1), corpus.repartition(13)))
    assert one[-1] is None and one[-2] is None and len(one) == 903
    assert all(one[k] == many[k] or abs(one[k] - many[k]) < 1e-6 for k in one)


def test_clashing_columns_and_no_rows(spark, corpus):
    extra = corpus.limit(40).selectExpr("doc_id", "text", "1 AS row", "'d' AS doc", "2 AS n_words", "3 AS more", "4 AS _text")
    got = m.scored(extra, rounds=1)
    assert got.columns == ["doc_id", "row", "doc", "more", "_text", "n_words", "log_likelihood", "mean_log"] and got.count() == 40
    assert m.scored(corpus.where("doc_id > 9999"), rounds=1).count() == 0


def test_places_of_hashes():
    r = np.random.default_rng(3)
    every = r.integers(0, 1 << 64, 5000, np.uint64)
    ends = np.array([0, 1, (1 << 64) - 1], np.uint64)
    asked = np.concatenate([every, ends])
    for some in (every[:0], every[:1], ends, every[:3000], every[:3000] >> np.uint64(40)):
        some = np.unique(some)
        want = [int(np.flatnonzero(some == h)[0]) if h in some else -1 for h in asked]
        assert m.Places(some).of(asked).tolist() == want


def test_contexts_of_some_words():
    ids, counts = np.arange(20, dtype=np.int32), np.array([0, 1, 7, 12])
    pick = np.array([0, 1, 7, 8, 19])
    assert (m.contexts(ids, counts, pick) == m.contexts(ids, counts)[pick]).all()


def test_gradient_steps():
    """A step moves each parameter by the gradient of the mean cross-entropy over the root of its square."""
    r = np.random.default_rng(4)
    context, target = r.integers(0, m.VOCABULARY + 1, (40, 2 * m.SIDE)).astype(np.int32), r.integers(0, m.VOCABULARY, 40).astype(np.int32)
    net = m.Network.start(r.random(m.VOCABULARY))
    trainer = m.Trainer(net)
    trainer.learn(context, target)
    for name, at in (("k", (3, 5)), ("kb", (7,)), ("o", (int(target[0]) // m.CLASS, 2, int(target[0]) % m.CLASS)), ("ob", (int(target[1]) // m.CLASS, 9)), ("b", (4,))):
        x = [m.Network.of(net.flat()) for _ in range(2)]
        getattr(x[0], name)[at] += 0.01
        getattr(x[1], name)[at] -= 0.01
        gradient = (x[1].logs(context, target).mean() - x[0].logs(context, target).mean()) / 0.02
        moved = getattr(trainer.net, name)[at] - getattr(net, name)[at]
        assert abs(moved + m.RATE * gradient / math.sqrt(1e-3 + gradient**2)) < 5e-4
    assert np.abs(m.Trainer(net).net.flat() - net.flat()).max() == 0
