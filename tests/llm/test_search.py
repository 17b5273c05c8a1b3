"""Near duplicates, repeats, digests and tiling against brute force on small tables."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import bucket_digest as Q
from sheaf.llm import order_minhash as O
from sheaf.llm import string_tiling as G
from sheaf.llm import suffix_dedup as X
from sheaf.llm.words import words
from tests.llm.conftest import edited, sentence


def _hashes(text):
    return words(pa.array([text or ""])).of(0)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_banded_alignment_is_the_edit_distance(a, b, limit):
    d = _distance(a, b)
    assert O.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (d if d <= limit else None)


def test_order_counts():
    """Same k-mers in another order share fewer order-MinHash vectors than k-mers do."""
    rng = random.Random(1)
    parts = [sentence(rng, 12) for _ in range(20)]
    a, b = _hashes(" ".join(parts)), _hashes(" ".join(reversed(parts)))
    seeds = np.random.default_rng(0).integers(1, 2**63, 400, dtype=np.uint64)
    share = lambda keep: (O.sketch(a, keep=keep, seeds=seeds)[0] == O.sketch(b, keep=keep, seeds=seeds)[0]).mean()
    assert share(1) > 0.7 and share(2) < 0.75 * share(1)


def test_sketches_pass_block_borders():
    rng = random.Random(2)
    h = _hashes(sentence(rng, 500))
    whole = O.sketch(h)
    before, O._BLOCK = O._BLOCK, 64
    try:
        parts = O.sketch(h)
    finally:
        O._BLOCK = before
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(7)
    docs, n = {}, 0
    for size in (40, 90, 200, 600):
        for copies in (2, 3, 6):
            base = sentence(rng, size)
            for k in range(copies):
                docs[n] = base if k % 3 == 1 else edited(rng, base, rng.choice([0.02, 0.06, 0.1]))
                n += 1
    for _ in range(40):
        docs[n] = sentence(rng, rng.choice([5, 60, 300]))
        n += 1
    return docs


def _groups(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_near_duplicates_against_all_pairs(spark, copies):
    h = {i: _hashes(t).tolist() for i, t in copies.items()}
    near = {(a, b) for a in h for b in h if a < b and min(len(h[a]), len(h[b])) >= 0.7 * max(len(h[a]), len(h[b])) and _distance(h[a], h[b]) <= 0.3 * max(len(h[a]), len(h[b])) + 1e-9}
    docs = spark.createDataFrame(list(copies.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["kept_id"], r["similarity"]) for r in O.near_duplicates(docs).collect()}
    want = {x: r for x, r in _groups(near, h).items() if x != r}
    found = {x: k for x, (k, _) in got.items()}
    assert set(found) <= set(want) and len(set(want) & set(found)) >= 0.95 * len(want)
    assert sum(found.get(x) == r for x, r in want.items()) >= 0.95 * len(want)
    for x, (_, s) in got.items():
        best = max(1 - _distance(h[x], h[y]) / max(len(h[x]), len(h[y])) for y in h if (min(x, y), max(x, y)) in near)
        assert s <= best + 1e-6
    kept = {r["doc_id"] for r in O.keep_first(docs).collect()}
    assert kept == set(copies) - set(found)


def test_a_vector_of_most_texts_is_split(spark, monkeypatch):
    """Different texts that are nearly alike, in parts of at most 20: their leaders meet, so they are one group; buckets are thinned to their leaders."""
    rng = random.Random(17)
    base = sentence(rng, 80)
    docs = [(i, edited(rng, base, 0.03)) for i in range(90)] + [(200 + i, sentence(rng, 80)) for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_id"] for r in O.near_duplicates(table, split=20).collect()}
    assert got == {i: 0 for i in range(1, 90)} == {r["doc_id"]: r["kept_id"] for r in O.near_duplicates(table).collect()}
    rows = pd.DataFrame({"key": [1] * 90 + [2], "part": 0, "parts": 1, "doc_id": range(91), "n_words": 80, "bins": [O.sketch(_hashes(t))[1] for _, t in docs[:91]]})
    monkeypatch.setattr(O, "HELD", 10)
    held = []
    thin = lambda pdf: (pdf.iloc[:0], held.append(len(pdf)) or pdf.iloc[:1])
    done = list(O._by_key((rows.iloc[i : i + 7] for i in range(0, 91, 7)), lambda pdf: pdf, ["key", "part"], thin))
    assert max(held) < 20 and len(done[-1]) == 1


def test_repeated_rows_stay_once(spark):
    rng = random.Random(19)
    t, u, v = (sentence(rng, 60) for _ in range(3))
    docs = spark.createDataFrame([(1, t, "x"), (1, t, "y"), (2, t, "x"), (3, u, "x"), (3, v, "x"), (4, "", "x"), (4, "", "x"), (None, t, "x")], "doc_id bigint, text string, __nth string")
    assert sorted((r[0] or 0, r[1]) for r in O.keep_first(docs).collect()) == sorted([(1, t), (3, u), (3, v), (4, ""), (4, ""), (0, t)])


def test_near_duplicates_on_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["kept_id"]) for r in O.near_duplicates(odd).collect()}
    assert got == {(2, 1), (6, 5)}
    kept = O.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3  # both rows of 2, and 6
    assert O.near_duplicates(none).count() == 0


# ---- suffix arrays


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([7, 13, 21, 31]), st.sampled_from([1, 4, 1000]))
def test_suffix_array_against_sorting(tokens, period, bucket):
    got = X.suffix_array(np.array(tokens, np.int64), period=period, bucket=bucket)
    assert got.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])


def test_suffix_array_of_runs_and_periods():
    for tokens in ([1] * 200, [1, 2] * 120, [3, 1, 2] * 50 + [3, 1] + [3, 1, 2] * 50):
        got = X.suffix_array(np.array(tokens))
        assert got.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])


@pytest.mark.parametrize("period", list(X.COVERS))
def test_covers_cover_every_difference(period):
    assert (X._offsets(period) >= 0).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 4), st.integers(0, 6))
def test_winnowing_keeps_the_least_of_every_window(values, k, more):
    h = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = k + more
    from sheaf.llm.words import grams

    g = grams(h, k)
    w = least - k + 1
    want = {i for s in range(len(g) - w + 1) for i in range(s, s + w) if g[i] == g[s : s + w].min()}
    assert set(X.winnow(h, k, least).tolist()) == want


def _plain_repeats(docs, least):
    at = {}
    h = {i: _hashes(t).tolist() for i, t in docs}
    for i, w in h.items():
        for s in range(len(w) - least + 1):
            at.setdefault(tuple(w[s : s + least]), set()).add((i, s))
    out = set()
    for i, w in h.items():
        covered = sorted(s for s in range(len(w) - least + 1) if len(at[tuple(w[s : s + least])]) > 1)
        spans = []
        for s in covered:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + least
            else:
                spans.append([s, s + least])
        out |= {(i, a, b, b - a) for a, b in spans}
    return out


def test_repeats_against_all_windows(spark):
    rng = random.Random(11)
    shared = [sentence(rng, n) for n in (12, 20, 33, 60)]
    docs = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [edited(rng, rng.choice(shared), rng.choice([0, 0, 0.05])), sentence(rng, rng.randint(0, 30))]
        docs.append((i, " ".join(parts)))
    docs += [(100, "x y " * 40), (101, "q " * 30), (102, docs[3][1]), (103, docs[3][1] + " more words")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    for hot, skewed in ((X.HOT, X.SKEWED), (3, X.SKEWED), (3, 3), (1, 1)):  # by suffix arrays; by what stands beside, after a window or a count; by runs
        assert {tuple(r) for r in X.repeats(table, 12, hot=hot, skewed=skewed).collect()} == _plain_repeats(docs, 12)


@pytest.mark.parametrize("least", [50, 260, 300])
def test_long_least_passages_are_whole(spark, least):
    rng = random.Random(least)
    shared = sentence(rng, 400)
    docs = [(i, f"{sentence(rng, 40 * i)} {shared} {sentence(rng, 350)}") for i in range(3)]
    got = {tuple(r) for r in X.repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), least).collect()}
    assert got == _plain_repeats(docs, least) and all(n >= 400 for *_, n in got)


def test_a_line_in_most_documents_meets_in_no_task(spark, monkeypatch):
    """A line of 30 words in nine of ten documents: its anchors are counted, none of its windows is put in a suffix array."""
    rng = random.Random(12)
    line = sentence(rng, 30)
    docs = [(i, f"{sentence(rng, rng.randint(20, 60))} {line if i % 10 else ''} {sentence(rng, rng.randint(20, 60))}") for i in range(300)]
    docs += [(1000 + i, f"{sentence(rng, 20)} {line} {sentence(random.Random(5), 40)} {sentence(rng, 20)}") for i in range(3)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    windows, largest = X._windows, []
    monkeypatch.setattr(X, "_windows", lambda own, spots, gram: largest.append(spots.groupBy("key").count().agg({"count": "max"}).first()[0]) or windows(own, spots, gram))
    for skewed in (X.SKEWED, 50):
        got = {tuple(r) for r in X.repeats(table, 50, hot=50, skewed=skewed).collect()}
        assert max(largest) <= 50 and got == _plain_repeats(docs, 50)
    assert got == _plain_repeats(docs, 50) and {i for i, *_ in got} == {1000, 1001, 1002}


def test_repeats_on_odd_rows(spark, odd, none):
    got = {tuple(r) for r in X.repeats(odd).collect()}
    rows = [(i, t) for i, t in {(r["doc_id"], r["text"]) for r in odd.collect()} if i is not None]
    assert got == _plain_repeats(rows, 50) and X.repeats(none).count() == 0


# ---- digests


def _digest_pairs(docs):
    d = Q.digests(pa.array([t for _, t in docs]))
    return {i: x for (i, _), x in zip(docs, d, strict=True) if x}


def test_difference_is_a_bounded_sum():
    rng = random.Random(5)
    text = sentence(rng, 400)
    a, b, c = Q.digests(pa.array([text, edited(rng, text, 0.02), "".join(rng.choices("qwxzkj ", k=3000))]))
    assert Q.difference(a, a) == 0 and Q.difference(a, b) == Q.difference(b, a)
    assert Q.difference(a, b) < Q.difference(a, c) and Q.difference(a, c, 20) == 20
    codes = Q._codes(np.stack([np.frombuffer(x, np.uint8) for x in (a, b)])).astype(int)
    body = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(*codes, strict=True))
    assert Q.difference(a, b) >= body and Q.difference(a, b) - body < 60


def test_digests_don_t_depend_on_neighbours():
    rng = random.Random(6)
    texts = [sentence(rng, n) for n in (3, 30, 300)] + [None, "", "a" * 49, "é" * 200]
    alone = [Q.digests(pa.array([t], pa.string()))[0] for t in texts]
    assert Q.digests(pa.array(texts)) == alone and alone[3:6] == [None] * 3


def test_fingerprints_against_all_pairs(spark):
    rng = random.Random(8)
    docs = []
    for _ in range(40):
        base = sentence(rng, rng.choice([80, 300, 900]))
        docs += [base, edited(rng, base, 0.004), edited(rng, base, 0.01), base if rng.random() < 0.3 else sentence(rng, 100)]
    docs = list(enumerate(docs))
    d = _digest_pairs(docs)
    got = {r["doc_id"]: r for r in Q.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(got) == len(docs)
    hit = total = 0
    for i, x in d.items():
        score, match = min((Q.difference(x, y), j) for j, y in d.items() if j != i)
        assert got[i]["digest"] == x.hex()
        if got[i]["match_id"] is not None:
            assert got[i]["difference"] == Q.difference(x, d[got[i]["match_id"]]) <= Q.BOUND and got[i]["difference"] >= score
        if score <= Q.BOUND:
            total += 1
            hit += got[i]["match_id"] is not None and (got[i]["difference"], got[i]["match_id"]) == (score, match)
    assert total >= 40 and hit >= 0.9 * total


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_bands_meet_where_lengths_are_near(seed):
    rng = np.random.default_rng(seed)
    many = rng.integers(0, 256, (2, Q.SIZE), dtype=np.uint8)
    many[1] = many[0]
    many[1, 1] = (int(many[0, 1]) + rng.integers(-3, 4)) % 256
    owner, key = Q.band_keys(many)
    assert set(key[owner == 0]) & set(key[owner == 1])


def test_a_band_of_nearly_all_digests_is_split(spark, monkeypatch):
    """Digests of edited copies share most bands: none is compared whole above 40, and the nearest is found as without a limit."""
    rng = random.Random(23)
    base = sentence(rng, 500)
    docs = [(i, edited(rng, base, 0.01)) for i in range(150)] + [(500 + i, sentence(rng, 100)) for i in range(15)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    d = _digest_pairs(docs)
    seen = spark.sparkContext.accumulator(0)
    within = Q.nearest

    def counted(ids, many, bound=Q.BOUND):
        seen.add(len(ids) > 60)
        return within(ids, many, bound)

    monkeypatch.setattr(Q, "nearest", counted)
    for splits in (0, 2):
        got = {r["doc_id"]: (r["match_id"], r["difference"]) for r in Q.fingerprints(table, most=40, splits=splits).collect()}
        right = sum(got[i][1] == min(Q.difference(x, y) for j, y in d.items() if j != i) for i, x in d.items() if i < 500)
        assert right >= 0.95 * 150 and seen.value == 0


def test_fingerprints_on_odd_rows(spark, odd, none):
    got = {r["doc_id"]: (r["match_id"], r["difference"]) for r in Q.fingerprints(odd).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11} and got[1] == (2, 0) and got[2] == (1, 0) and got[5][0] == 6 and got[3] == (None, None)
    assert Q.fingerprints(none).count() == 0
    with pytest.raises(ValueError):
        Q.fingerprints(odd, Q.BOUND + 1)


# ---- tiling


def _plain_tiles(item, doc, least):
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_i[a + n] and free_d[b + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return out
        a, b, n = best
        free_i[a : a + n] = free_d[b : b + n] = [False] * n
        out.append(best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=18), st.lists(st.integers(0, 2), max_size=24), st.integers(2, 4))
def test_tiles_are_the_greedy_ones(item, doc, least):
    got = G.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least)
    assert got == _plain_tiles(item, doc, least)


def _plain_leaks(docs, items, least=G.LEAST, coverage=G.COVERAGE):
    out = {}
    for i, t in docs:
        for k, s in items:
            item, doc = _hashes(s).tolist(), _hashes(t).tolist()
            tiled = _plain_tiles(item, doc, least)
            if tiled and sum(n for *_, n in tiled) >= coverage * len(item):
                out[i, k] = (round(sum(n for *_, n in tiled) / len(item), 6), len(tiled), tiled[0][2])
    return out


@pytest.fixture(scope="module")
def leaking():
    rng = random.Random(13)
    items = [(k, sentence(rng, rng.randint(14, 30))) for k in range(8)] + [(50, "two words"), (51, None), (None, "a b c d e f"), (52, "")]
    docs = []
    for i in range(30):
        _, passage = items[i % 8]
        w = passage.split(" ")
        half = len(w) // 2
        kind = i % 5
        inside = [passage, " ".join(w[half:] + ["zzz"] + w[:half]), edited(rng, passage, 0.1), " ".join(w[:4]), sentence(rng, 20)][kind]
        docs.append((i, f"{sentence(rng, 15)} {inside}. {sentence(rng, 15)}"))
    return docs, items


def test_leaks_against_plain_tiling(spark, leaking):
    docs, items = leaking
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = _plain_leaks(docs, [(k, s) for k, s in items if k is not None and s is not None])
    assert {i for i, _ in want} >= {i for i in range(30) if i % 5 in (0, 1)} and not {i for i, _ in want} & {i for i in range(30) if i % 5 in (3, 4)}
    for limit in (G.BROADCAST_WORDS, 10):  # in one pass and in many
        got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"], r["longest_tile"]) for r in G.leaks(d, b, limit=limit).collect()}
        assert got == want
        assert {r["doc_id"] for r in G.keep_clean(d, b, limit=limit).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_on_odd_rows(spark, odd, none, leaking):
    b = spark.createDataFrame(leaking[1], "item_id bigint, text string")
    assert G.leaks(odd, b).count() == 0 and G.leaks(none, b).count() == 0 and G.leaks(odd, b.where("false")).count() == 0
    assert sorted(map(repr, G.keep_clean(odd, b).collect())) == sorted(map(repr, odd.collect()))
