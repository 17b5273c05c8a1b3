"""Pairs that counted words rule out go before their texts are sent, and no near duplicate with them."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import order_minhash as O


def _unique(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_counted_words_bound_the_distance():
    """Never more than the edit distance, for classes of one or two sizes and counts that end at 255; the same both ways."""
    rng = np.random.default_rng(51)
    for n in [1, 2, 5, 63, 64, 65, 128, 129, 250, 257, 600] * 3:
        vocabulary = rng.integers(0, 2**64, rng.choice([1, 3, 50, 5000]), dtype=np.uint64)
        a = rng.choice(vocabulary, n)
        b = a.copy()
        b[rng.random(n) < rng.choice([0.05, 0.3, 1])] = rng.choice(vocabulary)
        b = np.concatenate([b[rng.random(n) > 0.1], rng.choice(vocabulary, rng.integers(1, 20))])
        least = O.least_distance(O.counted(a), O.counted(b))
        assert least == O.least_distance(O.counted(b), O.counted(a)) and least <= O.banded_distance(a, b, len(a) + len(b)), n
    other = np.full(300, 2**63 + 5, np.uint64)
    assert O.least_distance(O.counted(other), O.counted(other ^ np.uint64(2**63))) == 255
    assert O.least_distance(O.counted(other), O.counted(other)) == 0


def test_texts_are_sent_for_possible_pairs_alone(spark, monkeypatch):
    """Texts of which every group shares a passage, too little of it for near duplicates: those planted are found, and few others are aligned."""
    sent = []
    aligned = O.verified
    monkeypatch.setattr(O, "verified", lambda docs, pairs, similarity: sent.append(pairs.count()) or aligned(docs, pairs, similarity))
    rng = random.Random(52)
    docs, planted = [], []
    for _ in range(12):
        passage = _unique(rng, 45)
        docs += [" ".join(passage + _unique(rng, 65)) for _ in range(15)]
        near = docs[-1].split(" ")
        near[70:90] = _unique(rng, 20)
        planted.append((len(docs), len(docs) - 1))
        docs.append(" ".join(near))
    got = O.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))
    assert {(r["doc_id"], r["kept_id"]) for r in got.collect()} == set(planted)
    assert 12 <= sum(sent) <= 40, sent


def test_every_text_of_a_repeated_document_counts(spark):
    rng = random.Random(53)
    base, other = _unique(rng, 100), _unique(rng, 100)
    copy = base[:40] + _unique(rng, 10) + base[50:]
    docs = [(1, " ".join(other)), (1, " ".join(base)), (1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(_unique(rng, 100)))]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a bigint, b bigint")
    assert [tuple(r) for r in O.possible(O.sketches(rows), pairs).collect()] == [(1, 2)]
    assert [tuple(r) for r in O.near_duplicates(rows).collect()] == [(2, 1, 0.9)]


def test_sketches_are_sent_for_shared_keys_alone(spark, monkeypatch):
    """The pipeline's stage: of texts that share no key nothing is sent to be compared, and the copies among them go; so too where a key is in parts."""
    sent = []
    linked = O._linked
    monkeypatch.setattr(O, "_linked", lambda rows, *rest: sent.extend(rows.groupBy("key", "parts").count().collect()) or linked(rows, *rest))
    rng = random.Random(54)
    docs = [" ".join(_unique(rng, 80)) for _ in range(100)]
    docs += [" ".join(_unique(rng, 1) + docs[i].split(" ")[1:]) for i in range(10)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(100))
    assert sent and all(r["count"] > 1 for r in sent)
    rows = O.sketches(table).withColumn("keys", F.array_append("keys", F.lit(1).cast("bigint"))).cache()
    whole = {(r["a"], r["b"]) for r in O.candidates(rows).where("kind = 0").collect()}
    sent.clear()
    assert {(i, 100 + i) for i in range(10)} <= {(r["a"], r["b"]) for r in O.candidates(rows, split=20).where("kind = 0").collect()} & whole
    assert {r["key"] for r in sent if r["parts"] > 1} == {1} and all(r["count"] > 1 or r["key"] == 1 for r in sent)
