"""Recall by edit similarity, not by what the operators' own bounds let through."""

import random

from sheaf.llm import bucket_digest as Q
from sheaf.llm import order_minhash as O
from tests.llm.conftest import edited, sentence
from tests.llm.test_search import _digest_pairs


def test_digests_find_copies_by_their_edits(spark):
    rng = random.Random(31)
    docs, pairs = [], {0.02: [], 0.04: []}
    for share in pairs:
        for _ in range(100):
            base = sentence(rng, rng.choice([400, 800, 1500]))
            pairs[share].append((len(docs), len(docs) + 1))
            docs += [base, edited(rng, base, share)]
    docs = list(enumerate(docs))
    d = _digest_pairs(docs)
    got = {r["doc_id"]: r["match_id"] for r in Q.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    found = {share: sum(got[a] == b and got[b] == a for a, b in own) for share, own in pairs.items()}
    assert found[0.02] >= 90 and found[0.04] >= 75, found
    edge = [(a, b) for own in pairs.values() for a, b in own if 20 <= Q.difference(d[a], d[b]) <= Q.BOUND]
    assert len(edge) >= 20 and sum(got[a] is not None and got[b] is not None for a, b in edge) >= 0.9 * len(edge)


def _scattered(rng, text, edits):
    """``text`` with so many of its words replaced, at random places."""
    w = text.split(" ")
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def _same_group(spark, docs, pairs):
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = {r["doc_id"]: r["kept_id"] for r in O.near_duplicates(rows).collect()}
    return sum(kept.get(a, a) == kept.get(b, b) for a, b in pairs) / len(pairs)


def test_near_duplicates_up_to_the_limit(spark):
    rng = random.Random(32)
    unique = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs, long, short = [], [], []
    for k in range(400):
        n = rng.randint(60, 200) if k % 2 else rng.randint(4, 20)
        base = unique(n)
        edits = rng.randint(int(0.1 * n), int(0.3 * n + 1e-9)) if k % 2 else max(1, int(0.3 * n + 1e-9))
        (long if k % 2 else short).append((len(docs), len(docs) + 1))
        docs += [base, _scattered(rng, base, edits)]
    fixed = [("a1 b1 c1 d1 e1", "a1 b1 x1 d1 e1"), ("a2 b2 c2", "a2 b2 c2 d2"), ("a3 b3 c3 d3", "a3 x3 c3 d3")]
    for x, y in fixed:
        short.append((len(docs), len(docs) + 1))
        docs += [x, y]
    docs = list(enumerate(docs))
    assert _same_group(spark, docs, long) >= 0.9 and _same_group(spark, docs, short) >= 0.95
    assert _same_group(spark, docs, short[-3:]) == 1


def test_copies_that_share_a_passage_with_older_texts(spark):
    rng = random.Random(33)
    unique = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, pairs = [], []
    for _ in range(30):
        passage = unique(60)
        docs += [" ".join(passage + unique(40)) for _ in range(15)]
        base = " ".join(passage + unique(40))
        pairs.append((len(docs), len(docs) + 1))
        docs += [base, _scattered(rng, base, 24)]
    assert _same_group(spark, list(enumerate(docs)), pairs) >= 0.9
