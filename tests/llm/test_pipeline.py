"""The pipeline against a plain version of each stage on its own input."""

import random

import pytest

import corpus_pipeline
from sheaf.llm import language_id as L
from sheaf.llm import secrets as S
from tests.llm.conftest import edited
from tests.llm.test_rowwise import WORDS, _plain_packing
from tests.llm.test_search import _distance, _groups, _hashes, _plain_leaks


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    words = {k: [w + x for w in v.split() for x in ("", "s", "en", "al", "or", "is")] for k, v in WORDS.items()}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    items = [(k, text("en", 20)) for k in range(3)]
    rows = [(i, text(k := ["en", "fr", "de"][i % 3], rng.randint(40, 90)), k, "s") for i in range(60)]
    rows += [(100 + i, edited(rng, rows[i][1], 0.03), rows[i][2], "s") for i in range(6)]
    rows += [(200 + i, f"{text('en', 30)} {items[i][1]} {text('en', 30)}", "en", "s") for i in range(3)]
    rows += [(300, text("en", 40) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + text("en", 10), "en", "s"), (400, "Привет как дела друзья мои хорошие " * 5, None, "s"), (401, "", None, "s"), (402, None, "en", None)]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages_against_plain_versions(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "pack"]
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        got = [tuple(r) for r in out.collect()]
        if name == "language_id":
            model = L.train(docs)
            want = [r for r in rows if model.identify([r[1]])[3][0]]
            assert {400, 401, 402} == {r[0] for r in rows} - {r[0] for r in want}
        elif name == "near_dedup":
            h = {r[0]: _hashes(r[1]).tolist() for r in rows}
            near = [(a, b) for a in h for b in h if a < b and _distance(h[a], h[b]) <= 0.3 * max(len(h[a]), len(h[b]))]
            group = _groups(near, h)
            want = [r for r in rows if group[r[0]] == r[0]]
            assert not {r[0] for r in want} & set(range(100, 106))
        elif name == "decontaminate":
            bad = {i for i, _ in _plain_leaks([(r[0], r[1]) for r in rows], items)}
            want = [r for r in rows if r[0] not in bad]
            assert bad == {200, 201, 202}
        elif name == "secret_scan":
            want = []
            for r in rows:
                t = r[1]
                for a, b, kind in reversed(S.confirm(t)):
                    t = f"{t[:a]}[SECRET:{kind}]{t[b:]}"
                want.append((r[0], t, r[2], r[3], len(t)))
            assert want != rows
        else:
            from sheaf.llm.best_fit import CAPACITY, OPEN
            from sheaf.llm.tokens import tokenizer

            placed = _plain_packing(sorted((r[0], tokenizer().count(r[1])) for r in rows), CAPACITY, OPEN)
            want = [(0, b, at, d, p, s, n) for d, p, s, n, b, at in placed]
        if name != "pack":
            assert out.columns == columns
        assert sorted(got) == sorted(want)
        tables.append(got)
        docs = spark.createDataFrame(got, out.schema) if name != "pack" else docs
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(tables[-1])


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
