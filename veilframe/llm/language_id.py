"""Language identification with a byte convolutional network, trained here in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a fixed-length window and classified by softmax.
A text is cut into windows that cover all of it; the mean of the windows' logits, weighted by their length, decides. For use,
embedding and filters fold into lookup tables of byte pairs, so a window costs a few gathers and additions.

Fitting reads at most ``texts_per_language`` training documents of each language, chosen by a hash of their id, and of the passages
that they fall into as a whole at most ``passages_per_language``, chosen likewise; with very many languages these bounds shrink so that
``sample_rows`` passages are enough for all, and every language keeps one at least. Any language of a training row can be
predicted. Prediction reads every text as a whole.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; training rows of null language or text are left out;
without training rows every text is ``und``; with one language every text with letters gets it; repeated rows get the
same result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import first_of, in_training, map_texts, materialize, passages


@dataclass(frozen=True)
class Settings:
    texts_per_language: int = 300
    passages_per_language: int = 600
    passage_chars: int = 2000
    sample_rows: int = 100_000
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    steps: int = 500
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Filters of width k: position i of a window scores sum over j of tables[k][j][byte i+j] + bias."""

    languages: list[str]
    window: int
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None
    offset: np.ndarray | None = None


def windows(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover all bytes, the last one padded with spaces, and the bytes that each holds."""
    n = -(-len(data) // size)
    flat = np.full(n * size, 32, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    held = np.full(n, size, np.float32)
    held[-1:] = len(data) - (n - 1) * size
    return flat.reshape(n, size), held


def prepared(text: str) -> bytes:
    return text.encode().lower()


def train(sample: list[tuple[str, str]], s: Settings = Settings()) -> Model:
    """Adam on cross-entropy; gradients pass only through the position that won each max."""
    languages = sorted({y for _, y in sample})
    if len(languages) < 2:
        return Model(languages, s.window)
    rng = np.random.default_rng(s.seed)
    by: list[list[np.ndarray]] = [[] for _ in languages]
    for text, y in sample:
        x, held = windows(prepared(text), s.window)
        by[languages.index(y)].extend(x[held >= min(24, s.window)])
    pools = [np.array(x) if x else np.full((1, s.window), 32, np.uint8) for x in by]
    d, c = s.embedding, len(languages)
    p = {"e": rng.normal(0, 0.5, (256, d)), "w": rng.normal(0, 0.1, (len(s.widths) * s.filters, c)), "o": np.zeros(c)}
    for k in s.widths:
        p[f"f{k}"], p[f"b{k}"] = rng.normal(0, 1 / np.sqrt(k * d), (k, d, s.filters)), np.zeros(s.filters)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, s.steps + 1):
        y = rng.integers(0, c, s.batch)
        x = np.stack([pools[i][rng.integers(len(pools[i]))] for i in y])
        pooled, best = [], {}
        for k in s.widths:
            at = s.window - k + 1
            z = sum((p["e"] @ p[f"f{k}"][j])[x[:, j : j + at]] for j in range(k)) + p[f"b{k}"]
            best[k] = z.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(z, best[k][:, None], 1)[:, 0], 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["w"] + p["o"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(s.batch), y] -= 1
        q /= s.batch
        g = {"w": h.T @ q, "o": q.sum(0), "e": np.zeros_like(p["e"])}
        back = (q @ p["w"].T) * (h > 0)
        for i, k in enumerate(s.widths):
            dz = back[:, i * s.filters : (i + 1) * s.filters]
            g[f"b{k}"], gf = dz.sum(0), np.zeros_like(p[f"f{k}"])
            for j in range(k):
                seen = np.take_along_axis(x, best[k] + j, 1)
                gf[j] = np.einsum("nf,nfd->df", dz, p["e"][seen])
                np.add.at(g["e"], seen.ravel(), (dz[:, :, None] * p[f"f{k}"][j].T[None]).reshape(-1, d))
            g[f"f{k}"] = gf
        for k, v in g.items():
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            p[k] = p[k] - s.rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    tables = {k: np.stack([p["e"] @ p[f"f{k}"][j] for j in range(k)]).astype(np.float32) for k in s.widths}
    return Model(languages, s.window, tables, {k: p[f"b{k}"].astype(np.float32) for k in s.widths}, p["w"].astype(np.float32), p["o"].astype(np.float32))


class Predictor:
    """Lookup tables of byte pairs; made once per task."""

    def __init__(self, m: Model):
        self.m = m
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.pairs = {k: ([pair(t[j], t[j + 1]) for j in range(0, k - 1, 2)], t[-1] if k % 2 else None) for k, t in m.tables.items()}

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of windows, row by row."""
        two = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for k, (pairs, odd) in self.pairs.items():
            at = x.shape[1] - k + 1
            z = pairs[0][two[:, :at]]
            for j, t in enumerate(pairs[1:], 1):
                z += t[two[:, 2 * j : 2 * j + at]]
            if odd is not None:
                z += odd[x[:, k - 1 : k - 1 + at]]
            pooled.append(np.maximum(z.max(1) + self.m.bias[k], 0))
        return np.concatenate(pooled, 1) @ self.m.weights + self.m.offset

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        chosen = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.m.languages else []
        if len(self.m.languages) == 1:
            for i in chosen:
                names[i], scores[i] = self.m.languages[0], 1.0
            return names, scores
        sums = np.zeros((len(chosen), len(self.m.languages)))
        held = np.zeros(len(chosen))
        parts, owners, weights, n = [], [], [], 0

        def flush() -> None:
            nonlocal parts, owners, weights, n
            if parts:
                x, own, w = np.concatenate(parts), np.concatenate(owners), np.concatenate(weights)
                np.add.at(sums, own, self.logits(x) * w[:, None])
                np.add.at(held, own, w)
            parts, owners, weights, n = [], [], [], 0

        for k, i in enumerate(chosen):
            x, w = windows(prepared(texts[i]), self.m.window)
            for at in range(0, len(x), 512):  # a long text passes in pieces, so memory stays level
                parts.append(x[at : at + 512])
                weights.append(w[at : at + 512])
                owners.append(np.full(len(parts[-1]), k))
                n += len(parts[-1])
                if n >= 512:
                    flush()
        flush()
        if chosen:
            mean = sums / held[:, None]
            q = np.exp(mean - mean.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            for k, i in enumerate(chosen):
                best = int(q[k].argmax())
                names[i], scores[i] = self.m.languages[best], float(q[k, best])
        return names, scores


def training_sample(docs: DataFrame, s: Settings) -> list[tuple[str, str]]:
    """(passage, language) of the chosen documents, without held-out rows."""
    own = docs.select("doc_id", "text", "lang").where(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = own.select("lang").distinct().count()
    if not languages:
        return []
    most = max(1, s.sample_rows // languages)
    ids = own.select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("h"))
    ids = first_of(ids, "lang", F.col("h"), [F.col("doc_id")], min(s.texts_per_language, most)).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    # At most sample_rows pairs of an id and a language. A document of several rows gives one text.
    texts = own.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    parts = texts.select("doc_id", "lang", F.explode(passages(F.col("text"), s.passage_chars)).alias("p")).select("doc_id", "lang", "p.at", "p.passage")
    parts = materialize(parts.withColumn("h", F.xxhash64("doc_id", "at")))
    rows = first_of(parts, "lang", F.col("h"), [F.col("doc_id"), F.col("at")], min(s.passages_per_language, most)).collect()
    return [(r.passage, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r["at"]))]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                names, scores = predictor.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (~in_training(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out"), "text")
    return map_texts(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def detect(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Trains on the labelled part of the documents and identifies all of them."""
    return identify(docs, train(training_sample(docs, s), s))
