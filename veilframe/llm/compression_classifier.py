"""Quality classifier by compression: texts like the good examples shrink more under a dictionary made of good text.

Two zstandard dictionaries are built from labelled text, one per class. A text is compressed with each, window by window of
``block_bytes`` bytes, so that what a window repeats of itself counts little beside what the dictionaries know of it. The normalised
difference of the compressed sizes, (bad - good) / (bad + good), goes through a logistic calibration that is fitted on whole labelled
texts which the dictionaries have not seen. A text of few bytes says little, so ``prior_bytes`` compressed bytes of the usual difference are
added to every text. Scores need one pass over the text and no shuffle.

Fitting reads at most ``sample_per_class`` labelled documents of each class, chosen by a hash of their id. One half is calibrated on, as
a whole; of the passages that the other half falls into, at most ``passages_per_class``, chosen likewise, make the dictionary.
Scoring reads every text as a whole.

Edge cases: null and empty texts get the calibrated score of the usual difference; labels of null quality, unknown
documents or several rows per document are left out, or count once; if one of the classes has no text for its dictionary or fewer than
``least_examples`` to calibrate on, every score is the share of good labels (0.5 without labels); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import first_of, in_training, map_texts, materialize, passages


@dataclass(frozen=True)
class Settings:
    sample_per_class: int = 3000
    passages_per_class: int = 4000
    passage_chars: int = 2000
    dictionary_bytes: int = 256_000
    block_bytes: int = 64
    level: int = 12
    least_examples: int = 8
    prior_bytes: int = 100
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """``weights``: of the difference and of one."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]
    usual: float = 0.0
    block_bytes: int = 64
    level: int = 12
    prior_bytes: int = 100


def blocks(text: str, size: int) -> Iterator[bytes]:
    data = text.encode()
    return (data[k : k + size] for k in range(0, len(data), size))


def dictionary(texts: list[str], s: Settings) -> bytes:
    """A zstandard dictionary of the passages; of very few, their raw content."""
    import zstandard

    samples = [t.encode() for t in texts]
    try:
        return zstandard.train_dictionary(s.dictionary_bytes, samples, level=s.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-s.dictionary_bytes :] or b"\n" * 16


class Scorer:
    """Holds the two compressors of a model; made once per task."""

    def __init__(self, m: Model):
        import zstandard

        self.model = m
        both = [zstandard.ZstdCompressionDict(d) for d in (m.good, m.bad)]
        for d in both:
            d.precompute_compress(level=m.level)
        self.pair = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in both]

    def sizes(self, text: str | None) -> tuple[int, int]:
        """Compressed sizes under the good and the bad dictionary."""
        good, bad = (c.compress for c in self.pair)
        a = b = 0
        for x in blocks(text or "", self.model.block_bytes):
            a += len(good(x))
            b += len(bad(x))
        return a, b

    def difference(self, sizes: tuple[int, int]) -> float:
        """Normalised and smoothed."""
        (good, bad), prior = sizes, self.model.prior_bytes
        return (bad - good + prior * self.model.usual) / (bad + good + prior)

    def score(self, text: str | None) -> float:
        at = self.model.weights[0] * 10 * self.difference(self.sizes(text)) + self.model.weights[1]
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, at))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton steps with a slight ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def picked(docs: DataFrame, labels: DataFrame, s: Settings, half: int) -> DataFrame:
    """(doc_id, quality, text) of the chosen training documents of a half, without held-out rows; one row per document."""
    own = labels.where(F.col("quality").isin(0, 1) & in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = first_of(own, "quality", F.xxhash64("doc_id"), [F.col("doc_id")], s.sample_per_class)
    # At most 2 * sample_per_class rows of two numbers are broadcast.
    found = F.broadcast(found.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == half))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(found, "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("quality").alias("quality"))


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[str, int]]:
    """(passage, quality): what the dictionaries are made of."""
    parts = picked(docs, labels, s, 0).select("doc_id", "quality", F.explode(passages(F.col("text"), s.passage_chars)).alias("p")).select("doc_id", "quality", "p.at", "p.passage")
    parts = materialize(parts.withColumn("h", F.xxhash64("doc_id", "at")))
    rows = first_of(parts, "quality", F.col("h"), [F.col("doc_id"), F.col("at")], s.passages_per_class).collect()
    return [(r.passage, r.quality) for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r["at"]))]


def calibration(docs: DataFrame, labels: DataFrame, model: Model, s: Settings) -> list[tuple[int, int, int]]:
    """(good, bad, quality): sizes of the whole texts of the other half, measured where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            sizes = [scorer.sizes(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([z[k] for z in sizes], pa.int64()) for k in (0, 1))], names=["doc_id", "quality", "good", "bad"])

    kinds = dict(docs.select("doc_id").dtypes) | dict(labels.select("quality").dtypes)
    rows = picked(docs, labels, s, 1).where("text <> ''").select("doc_id", "quality", "text")
    found = map_texts(rows, run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, good long, bad long").collect()
    return [(r.good, r.bad, r.quality) for r in sorted(found, key=lambda r: r.doc_id)]


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Dictionaries from one half of the labelled documents; the calibration on the other, which they have not seen."""
    sample = labelled_sample(docs, labels, s)
    by = {q: [t for t, x in sample if x == q] for q in (0, 1)}
    blind = Model(b"\n" * 16, b"\n" * 16, (0.0, 0.0), 0.0, s.block_bytes, s.level, s.prior_bytes)
    model = replace(blind, good=dictionary(by[1], s), bad=dictionary(by[0], s)) if by[0] and by[1] else blind
    held = calibration(docs, labels, model, s)
    good = [x for x in held if x[2] == 1]
    if not (by[0] and by[1]) or min(len(good), len(held) - len(good)) < s.least_examples:
        share = labels.where(F.col("quality").isin(0, 1) & in_training(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
        share = 0.5 if share is None else min(max(float(share), 1e-3), 1 - 1e-3)
        return replace(blind, weights=(0.0, math.log(share / (1 - share))))
    model = replace(model, usual=float(np.mean([(b - g) / (b + g) for g, b, _ in good])))
    scorer = Scorer(model)
    x = np.array([[10 * scorer.difference((g, b)), 1.0] for g, b, _ in held])
    weights = logistic(x, np.array([q for _, _, q in held], dtype=float))
    return replace(model, weights=(float(weights[0]), float(weights[1])))


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([scorer.score(x.as_py()) for x in b.column(2)], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (~in_training(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Fits on the labelled documents and scores all of them."""
    return score(docs, fit(docs, labels, s), s)


def keep_good(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = fit(docs, labels, s)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer.score(x.as_py()) >= s.threshold for x in b.column(place)], pa.bool_()))

    return map_texts(docs.select(*names), run, docs.schema)
