"""What a search or grouping finds depends on the texts alone, not on how many others share a key with them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import bucket_digest as Q
from sheaf.llm import order_minhash as O


def _packed(codes):
    body = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    return np.concatenate([np.tile(np.array([7, 100, 0], np.uint8), (len(codes), 1)), body.astype(np.uint8)], 1)


def _crowd(n=120):
    """Digests that agree in the buckets of band 0 alone, those of even and the next odd number within 28 of each other."""
    rng = np.random.default_rng(41)
    codes = rng.integers(1, 3, (n, Q.BUCKETS)).astype(np.uint8)
    codes[:, Q._BANDS[0]] = codes[0, Q._BANDS[0]]
    codes[1::2] = codes[0::2]
    outside = np.setdiff1d(np.arange(Q.BUCKETS), Q._BANDS[0])
    for i in range(1, n, 2):
        at = rng.permutation(outside)[:28]
        codes[i, at] = 3 - codes[i, at]
    return [(i, d.tobytes()) for i, d in enumerate(_packed(codes))]


def test_matches_don_t_depend_on_the_size_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(Q, "digest_table", lambda digests: digests)
    table = spark.createDataFrame(_crowd(), "doc_id bigint, digest binary")
    for most in (10, 50, Q.MOST):
        got = {r["doc_id"]: (r["match_id"], r["difference"]) for r in Q.fingerprints(table, most=most).collect()}
        assert got == {i: (i ^ 1, 28) for i in range(120)}, most


def test_a_search_for_some_compares_those_with_all(spark, monkeypatch):
    """Each document asked for has the match it has when all are; equal digests match without being asked, and the keys' work falls with the share asked."""
    monkeypatch.setattr(Q, "digest_table", lambda digests: digests)
    docs = _crowd()
    docs += [(200, docs[4][1]), (203, docs[4][1])]
    table = spark.createDataFrame(docs, "doc_id bigint, digest binary")
    whole = {r["doc_id"]: (r["match_id"], r["difference"]) for r in Q.fingerprints(table).collect()}
    assert whole[4] == (200, 0) and whole[203] == (4, 0) and whole[5] == (4, 28)
    for most in (10, Q.MOST):
        got = {r["doc_id"]: (r["match_id"], r["difference"]) for r in Q.fingerprints(table, most=most, every=5).collect()}
        assert got == {i: m if i % 5 == 0 or m[1] == 0 else (None, None) for i, m in whole.items()}


@pytest.mark.parametrize("how", [{}, {"split": 20}, {"held": 5}, {"together": 8}])
def test_every_resembling_pair_of_a_bucket_is_found(spark, how):
    """Of a chain of texts of one bucket each resembles those up to three places away: all these pairs are linked or left to be compared, in parts and with few rows held too."""
    n, how = 60, dict(how)
    together = {k: how.pop(k) for k in ("together",) if k in how}
    place = random.Random(43).sample(range(n), n)  # of each doc_id
    rows = [([7], i, 100, bytes((16 * k + 63 - j) // 64 + 1 for j in range(64))) for i, k in enumerate(place)]
    found = O.candidates(spark.createDataFrame(rows, "keys array<bigint>, doc_id bigint, n_words int, bins binary"), **how).cache()
    groups = spark.createDataFrame([], "node bigint, component bigint")
    rest = O.unproven(found.where("kind <> 0"), groups, **together)
    got = {(r["a"], r["b"]) for r in found.where("kind = 0").select("a", "b").union(rest).collect()}
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if abs(place[a] - place[b]) <= 3}


def test_short_near_duplicates_of_a_bucket_are_linked(spark):
    """Texts of few words that differ in 0.3 of them at most, each two in a bucket of their own: none is lost before alignment."""
    rng = random.Random(44)
    docs = []
    for _ in range(600):
        n = rng.choice([4, 5, 7, 10, 35, 44, 50, 62])
        base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        other = list(base)
        for at in rng.sample(range(1, n - 1), max(1, int(0.3 * n + 1e-9))):
            other[at] = f"new{rng.randrange(10**9)}"
        docs += [" ".join(base), " ".join(other)]
    rows = O.sketches(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))
    found = O.candidates(rows.withColumn("keys", F.array(F.expr("doc_id div 2")))).where("kind = 0").collect()
    assert {(r["a"], r["b"]) for r in found} == {(2 * i, 2 * i + 1) for i in range(600)}
