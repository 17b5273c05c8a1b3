"""URL filter: logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled table (the package's own or the caller's) by Newton steps on the driver, and blocks from the
score on at which whole hosts held out of training were unwanted nearly always; scoring runs over whole Arrow buffers, one hash per
byte window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import map_batches, table
from sheaf.llm.words import mix, slices

DIMENSIONS = 1 << 13
LENGTHS = (3, 4, 5)
PENALTY = 0.02
#: Share of blocked URLs that must be unwanted, on hosts the model wasn't trained on, and the parts the hosts are cut into for that.
PRECISION = 0.99
FOLDS = 5
#: (label, url) lines, 1 = unwanted: gambling, pills, adult, link farms, trackers, scams, phishing, warez, fakes. Written by hand, for no given table of pages.
LABELS = Path(__file__).with_name("url_labels.tsv")
#: Most labelled rows that the driver fits on.
MOST_LABELLED = 4000


def labelled_urls(spark: SparkSession, path: Path = LABELS) -> DataFrame:
    """(url, label) of the labelled table that comes with the package."""
    return spark.createDataFrame(read_labels(path), "url string, label int")


def read_labels(path: Path = LABELS) -> list[tuple[str, int]]:
    return [(url, int(label)) for label, url in (line.split("\t") for line in path.read_text().splitlines())]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (without port, user and leading www.) and path (with query, without fragment), lower-cased and percent-decoded."""
    rest = (url or "").strip().lower()
    rest = rest.split("://", 1)[1] if "://" in rest else rest.removeprefix("//")
    rest = rest.split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].split(":", 1)[0]
    return host.removeprefix("www.").strip("."), unquote(rest[cut:])


def features(urls: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url number, feature, weight) of every hashed n-gram; a URL's weights have length one over all its n-grams.

    The host's last label is left out where there are others: of few labelled hosts a model learns too much from .net or .org.
    """
    parts = [p for u in urls for host, path in [split_url(u)] for p in (host.rpartition(".")[0] or host, path)]
    raw = [f"^{p}$".encode("utf-8", "replace") if p else b"" for p in parts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    end = np.repeat(np.cumsum(sizes), sizes)
    part = np.repeat(np.arange(len(raw)), sizes)
    rows, columns = [], []
    for n in LENGTHS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + data[j : j + len(h)]
        ok = np.arange(len(h)) + n <= end[: len(h)]
        which = part[: len(h)][ok]
        rows.append(which // 2)
        columns.append((mix(h[ok] + (which % 2).astype(np.uint64) * np.uint64(0x51ED270B9F) + np.uint64(n << 50)) % np.uint64(dimensions)).astype(np.int64))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    column = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    count = np.bincount(row, minlength=len(urls))
    return row, column, 1 / np.sqrt(np.maximum(count, 1))[row]


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def scores(self, urls: list[str | None]) -> np.ndarray:
        row, column, value = features(urls, len(self.weights))
        z = np.bincount(row, value * self.weights[column], minlength=len(urls)) + self.bias
        return 1 / (1 + np.exp(-z))


def fit(rows: list[tuple[str, int]], dimensions: int = DIMENSIONS, penalty: float = PENALTY, steps: int = 30) -> UrlModel:
    """L2-penalised maximum likelihood by Newton steps in the span of the rows (as many unknowns as rows, plus the bias)."""
    if not rows:
        raise ValueError("no labelled URL")
    x = np.zeros((len(rows), dimensions))
    row, column, value = features([u for u, _ in rows], dimensions)
    np.add.at(x, (row, column), value)
    y = np.array([v for _, v in rows], float)
    gram = x @ x.T
    a, bias = np.zeros(len(rows)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(gram @ a + bias)))
        w = np.maximum(p * (1 - p), 1e-9)
        # stationarity: penalty * a = y - p, sum(y - p) = 0
        left = np.block([[gram + np.diag(penalty / w), np.ones((len(rows), 1))], [np.ones((1, len(rows))), np.zeros((1, 1))]])
        right = np.append(gram @ a + bias + (y - p) / w, 0.0)
        # rows of the first block: gram a + bias + penalty a / w = z, the working response
        solved = np.linalg.solve(left, right)
        done = np.abs(solved[:-1] - a).max() < 1e-9
        a, bias = solved[:-1], float(solved[-1])
        if done:
            break
    return UrlModel(x.T @ a, bias)


def held_out(rows: list[tuple[str, int]], folds: int = FOLDS) -> np.ndarray:
    """Score of each row by a model trained on the other folds; all URLs of a host lie in one fold."""
    hosts = [".".join(split_url(u)[0].split(".")[-2:]) for u, _ in rows]
    fold = np.array([int.from_bytes(blake2b(h.encode(), digest_size=4).digest(), "big") % folds for h in hosts])
    out = np.full(len(rows), 0.5)
    for k in range(folds):
        rest = [r for r, f in zip(rows, fold, strict=True) if f != k]
        own = np.flatnonzero(fold == k)
        if rest and len(own):
            out[own] = fit(rest).scores([rows[i][0] for i in own])
    return out


def calibrated(rows: list[tuple[str, int]], precision: float = PRECISION) -> float:
    """The least score from 0.5 on at and above which held-out URLs are unwanted in a share of ``precision``; over 1 if there is none."""
    scores, y = held_out(rows), np.array([v for _, v in rows])
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(rows) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)  # equal scores are blocked together
    fine = np.flatnonzero((right >= precision) & last)
    return max(0.5, float(scores[order][fine[-1]])) if len(fine) else 1.1


def train(labelled: DataFrame) -> UrlModel:
    """Fit on a small labelled table (url, label), with the threshold from held-out hosts; rows with nulls are left out, of more than MOST_LABELLED distinct rows those of the least hash count."""
    rows = labelled.select(F.col("url").cast("string"), F.col("label").cast("int")).where("url IS NOT NULL AND label IS NOT NULL").distinct()
    picked = sorted((r[0], r[1]) for r in rows.orderBy(F.xxhash64("url", "label"), "url").limit(MOST_LABELLED).collect())
    model = fit(picked)
    model.threshold = calibrated(picked)
    return model


def score(pages: DataFrame, model: UrlModel, threshold: float | None = None) -> DataFrame:
    """(page_id, url, host, score, blocked), one row for each row of ``pages``.

    Blocked are scores from ``threshold`` on, the model's own if none is given. A null or empty URL (or one without host and path) has
    score null and isn't blocked; very long URLs are hashed whole; null page_ids stay null; repeated rows are scored each and alike;
    other columns don't matter; an empty table gives none.
    """
    least = model.threshold if threshold is None else threshold
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "url"):
            urls = part.column("url").to_pylist()
            hosts = [split_url(u) for u in urls]
            known = np.array([any(h) for h in hosts])
            value = np.round(shared.value.scores(urls), 6)
            yield {
                "page_id": part.column("page_id"),
                "url": part.column("url"),
                "host": [h or None for h, _ in hosts],
                "score": pa.array(value, mask=~known),
                "blocked": known & (value >= least),
            }

    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    return map_batches(slim, work, "page_id bigint, url string, host string, score double, blocked boolean")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))
