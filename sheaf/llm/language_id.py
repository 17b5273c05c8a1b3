"""Language identification by interpolated Kneser-Ney character models.

One model per language, each order's n-grams kept as a sorted array of hashes beside their discounted
probabilities. A document gets the language whose model has the lowest cross-entropy per symbol; it is
rejected when even that one is too high for a text of its length, by limits calibrated on held-out texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import filter_rows, map_batches
from sheaf.llm.words import mix, slices

ORDER = 4
OTHER, GAP = 0, 1
#: Symbols whose 4-grams still are numbers of 63 bits; every letter of the training texts has its own below that (55,000 letters).
SYMBOLS = 55_000
#: Labelled texts fitted per language (with the two bounds below this is the only sample taken) and the part of them held out for calibration.
SAMPLE_PER_LANGUAGE = 400
HELD_OUT = 0.25
#: Longest labelled text, in characters, that is fitted, and most languages, those with most labelled texts.
SAMPLE_CHARS = 200_000
MOST_LANGUAGES = 500
#: Standard deviations above a language's mean cross-entropy at which a document is rejected.
REJECT_SDS = 6.0
#: Least spread (bits squared) a language is taken to have between texts of any length, so that odd but clean texts stay.
LEAST_VARIANCE = 0.04


def _points(joined: str) -> np.ndarray:
    return np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class KneserNey:
    """Sorted hash arrays of one language: per order the n-gram keys with discounted probabilities and the context keys with back-off weights."""

    symbols: int
    keys: list[np.ndarray] = field(default_factory=list)
    probs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def key(codes: np.ndarray, order: int) -> np.ndarray:
        return mix(codes.astype(np.uint64) + np.uint64(order << 40))

    @classmethod
    def fit(cls, codes: np.ndarray, symbols: int, order: int = ORDER) -> KneserNey:
        """codes: one ``order``-gram per symbol of the training text, as a number in base ``symbols``, the last symbol lowest."""
        model = cls(symbols)
        grams, counts = np.unique(codes, return_counts=True)
        levels = [(grams.astype(np.int64), counts)]
        for n in range(order - 1, 0, -1):  # a lower order counts the distinct symbols before it
            grams, counts = np.unique(levels[0][0] % symbols**n, return_counts=True)
            levels.insert(0, (grams, counts))
        for n, (grams, counts) in enumerate(levels, 1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            heads, where = np.unique(grams // symbols, return_inverse=True)
            total = np.bincount(where, counts)
            kinds = np.bincount(where)
            for name, at, values, key_order in (("keys", grams, (counts - discount) / total[where], n), ("contexts", heads, discount * kinds / total, 16 + n)):
                hashed = cls.key(at, key_order)
                by = np.argsort(hashed)
                getattr(model, name).append(hashed[by])
                getattr(model, "probs" if name == "keys" else "backoff").append(values[by])
        return model

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of the interpolated probability of each n-gram's last symbol."""
        p = np.full(len(codes), 1.0 / self.symbols)
        for n in range(1, len(self.keys) + 1):
            gram = codes % self.symbols**n
            own, found = _find(self.keys[n - 1], self.key(gram, n))
            ctx, known = _find(self.contexts[n - 1], self.key(gram // self.symbols, 16 + n))
            p = np.where(known, np.where(found, self.probs[n - 1][own], 0.0) + self.backoff[n - 1][ctx] * p, p)
        return -np.log2(p)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class LanguageModel:
    """alphabet: code of each code point; limits: per language (mean, variance floor, variance per 1/n) of held-out cross-entropy."""

    languages: list[str]
    alphabet: np.ndarray
    models: list[KneserNey]
    limits: np.ndarray
    symbols: int
    order: int = ORDER

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Packed n-grams of all texts and how many each text has. Runs of non-letters are one gap; each text starts after gaps."""
        texts = [t or "" for t in texts]
        pad = "\n" * self.order
        joined = pad.join(texts) + pad
        symbols = self.alphabet[_points(joined)] if len(joined.lower()) == len(joined) else None
        if symbols is None:  # lower-casing changed a length: do it per text
            texts = [t.lower() for t in texts]
            symbols = self.alphabet[np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(sizes + self.order) - sizes - self.order
        gap = symbols == GAP
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        kept = symbols[keep]
        before = np.concatenate([[0], np.cumsum(keep)])
        first, last = before[start], before[start + sizes]
        counts = last - first
        head = np.repeat(first, counts)
        at = head + np.arange(len(head)) - np.repeat(np.cumsum(counts) - counts, counts)
        codes = kept[at].astype(np.int64)
        for n in range(1, self.order):  # what lies before the text's start counts as gaps
            codes += np.where(at - n >= head, kept[np.maximum(at - n, 0)], GAP).astype(np.int64) * self.symbols**n
        return codes, counts

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per language and text (inf for a text without letters), symbols and letters per text."""
        codes, sizes = self.encode(texts)
        distinct, where = np.unique(codes, return_inverse=True)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full((len(sizes), len(self.models)), np.inf)
        for k, model in enumerate(self.models):  # one language at a time, so memory doesn't grow with their number
            sums = np.concatenate([[0.0], np.cumsum(model.logs(distinct)[where])])
            with np.errstate(invalid="ignore", divide="ignore"):
                out[:, k] = np.where(sizes > 0, (sums[edges[1:]] - sums[edges[:-1]]) / sizes, np.inf)
        marks = np.concatenate([[0], np.cumsum(codes % self.symbols != GAP)])
        letters = marks[edges[1:]] - marks[edges[:-1]]
        out[letters == 0] = np.inf
        return out, sizes, letters

    def identify(self, texts: list[str | None], sds: float = REJECT_SDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cross-entropy, symbols, accepted) of each text; ties go to the first language by name."""
        scores, sizes, letters = self.entropies(texts)
        if not self.models:
            return np.zeros(len(sizes), np.int64), np.full(len(sizes), np.inf), sizes, np.zeros(len(sizes), bool)
        best = np.argmin(scores, 1)
        value = scores[np.arange(len(best)), best]
        mean, floor, per = self.limits[best].T
        limit = mean + sds * np.sqrt(floor + per / np.maximum(sizes, 1))
        return best, value, sizes, (letters > 0) & (value <= limit)


def fit(samples: dict[str, list[str]], held_out: float = HELD_OUT) -> LanguageModel:
    """Train on texts per language; the last ``held_out`` of each list calibrates the rejection. Without any text the model accepts nothing."""
    languages = sorted(samples)
    seen, counts = np.unique(np.concatenate([_points("".join(samples[k])) for k in languages] or [np.zeros(0, np.uint32)]), return_counts=True)
    letters = [(c, p) for p, c in zip(seen.tolist(), counts.tolist(), strict=True) if chr(p).isalpha()]
    letters.sort(key=lambda x: (-x[0], x[1]))
    alphabet = np.full(0x110000, OTHER, np.uint16)
    alphabet[[i for i in range(0x110000) if not chr(i).isalpha()]] = GAP
    letters = letters[: SYMBOLS - 2]
    for code, (_, point) in enumerate(letters, 2):
        alphabet[point] = code
    model = LanguageModel(languages, alphabet, [], np.zeros((len(languages), 3)), len(letters) + 2)
    rest = {}
    for k in languages:
        n = max(1, len(samples[k]) - int(len(samples[k]) * held_out))
        codes, _ = model.encode(samples[k][:n])
        if not len(codes):
            codes = np.full(1, sum(GAP * model.symbols**n for n in range(ORDER)), np.int64)
        model.models.append(KneserNey.fit(codes.astype(np.int64), model.symbols))
        rest[k] = samples[k][n:] or samples[k]
    for i, k in enumerate(languages):
        pieces, sizes, values = [], [], []
        for text in rest[k]:  # whole texts, and pieces of them, show how the spread falls with length
            pieces += [text] + [text[a : a + n] for n in (40, 160, 640) for a in range(0, max(1, len(text) - n), max(n, len(text) // 4))]
        scores, n, letters = model.entropies(pieces)
        ok = letters > 0
        values, sizes = scores[ok, i], n[ok]
        if not len(values):
            model.limits[i] = (np.log2(model.symbols), 1.0, 1.0)
            continue
        mean = float(np.average(values, weights=sizes))
        spread = (values - mean) ** 2
        a = np.stack([np.ones(len(sizes)), 1 / sizes], 1)
        (floor, per), *_ = np.linalg.lstsq(a, spread, rcond=None)
        model.limits[i] = (mean, max(float(floor), LEAST_VARIANCE), max(float(per), 1e-2))
    return model


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` labelled documents of each language, those of the least hashed doc_id; whole texts of up to SAMPLE_CHARS characters.

    Rows with a null doc_id, lang or text and empty texts are left out, equal rows count once; where nothing is labelled the model rejects every text.
    """
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.where(f"doc_id IS NOT NULL AND lang IS NOT NULL AND text <> '' AND length(text) <= {SAMPLE_CHARS}")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_language)
    frequent = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select(F.col("lang").alias("__lang"))
    chosen = chosen.join(F.broadcast(frequent), F.col("lang") == F.col("__lang"), "left_semi")
    ids = [r["doc_id"] for r in chosen.select("doc_id").distinct().collect()]  # per_language a language at most
    picked = docs.sparkSession.createDataFrame([(i,) for i in ids], "__id bigint") if ids else None
    samples: dict[str, list[str]] = {}
    if picked is not None:
        rows = labelled.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "lang", "text").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").collect()
        for r in rows:
            samples.setdefault(r["lang"], []).append(r["text"])
    return fit(samples)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang, cross_entropy, n_symbols, accepted), one row for each row of ``docs``.

    lang is null and accepted false for a rejected document: one without letters (null and empty texts too; cross_entropy
    is null then) or one that no model fits. Very long texts are scored whole, as a slice of their own; repeated rows are answered
    each; ties go to the first language by name; other columns don't matter; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            best, value, sizes, ok = shared.value.identify(part.column("text").to_pylist())
            names = shared.value.languages
            yield {
                "doc_id": part.column("doc_id"),
                "lang": [names[b] if k else None for b, k in zip(best.tolist(), ok.tolist(), strict=True)],
                "cross_entropy": [round(v, 6) if np.isfinite(v) else None for v in value.tolist()],
                "n_symbols": sizes,
                "accepted": ok,
            }

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, work, "doc_id bigint, lang string, cross_entropy double, n_symbols bigint, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that some language model accepts, all columns unchanged.

    Null, empty and letterless texts go; rows with a null doc_id are judged by their text; repeated rows stay or go together; very
    long texts are scored whole; a model fitted on nothing keeps no row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([shared.value.identify(p.column("text").to_pylist())[3] for p in slices(batch)])

    return filter_rows(docs, keep)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
