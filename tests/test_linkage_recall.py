"""Recall of the bucketed neighbour search on the table that its query runs on."""

from pathlib import Path

import numpy as np
import pytest

from sheaf.operators import linkage
from sheaf.plans.linking import knn_lsh, vectors

SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_knn_lsh_recall_on_the_embeddings_table(spark):
    rows = vectors(spark, str(SF)).select("id", "vector").collect()
    ids, x = np.array([r["id"] for r in rows]), np.array([r["vector"] for r in rows], float)
    scores = x @ x.T
    np.fill_diagonal(scores, -9)
    want = {(int(i), int(ids[j])) for i, row in zip(ids, scores, strict=True) for j in np.argsort(-row)[:4]}
    got = {(r["src"], r["dst"]) for r in knn_lsh(spark, str(SF)).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_close_neighbours_stay_with_the_buckets(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 16)), 5, 0) + 0.02 * rng.normal(size=(200, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>")
    assert linkage.bucket_recall(v) >= linkage.RECALL
    assert linkage.bucket_recall(v.where("false")) == 1 and linkage.nearest_lsh(v.where("false")).count() == 0
