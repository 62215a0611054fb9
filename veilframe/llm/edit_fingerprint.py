"""Document fingerprints by randomised edit embedding.

A random walk reads a text: at step i it stands at a character c and moves on if bit r(i, c) is set. All texts share the bits,
so two walks that an edit throws out of step meet again soon, and edit distance becomes Hamming distance between the sequences
that the walks write. The waiting time at a character depends on the step and the character only, so a table of waiting times
moves a walk a character per lookup. Every text is walked as a whole, many texts side by side, and the ends of the longest ones
one by one.

A fingerprint keeps, for each of ``slots`` random classes of (step, character) pairs, 8 bits of the least hash: two texts agree in
a slot with the probability that their written sequences share its pair. Slots sampled into bands give candidate pairs, which the
fingerprints verify.

Edge cases: a null text is empty; empty texts have one common fingerprint and likeness 1 to each other, 0 to any other; texts
shorter than the slots leave slots empty, which count only where one of two fingerprints has them; rows that repeat are
neighbours of each other in the order of ids; null ids come first; one document is its own next; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from veilframe.llm.common import map_texts, materialize, text_key
from veilframe.llm.components import components
from veilframe.llm.shingles import mix


@dataclass(frozen=True)
class Walk:
    classes: int = 64
    period: int = 4096
    slots: int = 128
    seed: int = 5


EMPTY = 255
#: So many characters are walked or hashed at once, and from so many texts on side by side.
ROWS, AT_ONCE, SIDE_BY_SIDE = 1024, 1 << 20, 64


class Embedder:
    """Walks texts and draws their fingerprints; made once per task."""

    def __init__(self, w: Walk = Walk()):
        self.w = w
        rng = np.random.default_rng(w.seed)
        bits = rng.integers(0, 2, (w.classes, 2 * w.period), dtype=np.uint8)
        bits[:, -1] = 1
        # wait[c, i]: steps from i on until a set bit lets the walk leave a character of class c.
        wait = np.zeros((w.classes, 2 * w.period), np.int32)
        wait[:, -1] = 1
        for i in range(2 * w.period - 2, -1, -1):
            wait[:, i] = np.where(bits[:, i] == 1, 1, wait[:, i + 1] + 1)
        self.wait = np.ascontiguousarray(wait[:, : w.period]).ravel()
        self.waits = self.wait.tolist()

    def _steps(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Per text, the steps at which its walk reaches its characters."""
        mask = self.w.period - 1
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        base = [(mix(texts[k].astype(np.uint64)) & np.uint64(self.w.classes - 1)).astype(np.int32) * self.w.period for k in order]
        out = [np.empty(len(b), np.int64) for b in base]
        at = np.zeros(len(base), np.int64)
        first, n = 0, len(base)
        while True:
            while n and len(base[n - 1]) <= first:
                n -= 1
            if n < SIDE_BY_SIDE:
                break
            # The longest come first, so those that are still on their way are the first n.
            part = np.zeros((min(ROWS, len(base[0]) - first), n), np.int32)
            for c in range(n):
                own = base[c][first : first + len(part)]
                part[: len(own), c] = own
            steps, now = np.empty(part.shape, np.int64), at[:n].copy()
            for j in range(len(part)):
                steps[j] = now
                now = now + self.wait[part[j] + (now & mask)]
            for c in range(n):
                size = min(len(part), len(base[c]) - first)
                out[c][first : first + size] = steps[:size, c]
            at[:n] = now
            first += len(part)
        waits = self.waits
        for c in range(n):
            now, steps = int(at[c]), []
            for b in base[c][first:].tolist():
                steps.append(now)
                now += waits[b + (now & mask)]
            out[c][first:] = steps
        return [x for _, x in sorted(zip(order, out, strict=True), key=lambda x: x[0])]

    def prints(self, texts: list[str]) -> np.ndarray:
        """One row of slots per text."""
        w = self.w
        # Least hash of every slot: 56 bits, all ones where there is none.
        least = np.full(len(texts) * w.slots, (1 << 56) - 1, np.uint64)
        first = 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars + len(texts[last]) <= AT_ONCE):
                chars += len(texts[last])
                last += 1
            lot = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts[first:last]]
            steps = np.concatenate(self._steps(lot))
            codes = np.concatenate(lot)
            owner = np.repeat(np.arange(first, last), [len(x) for x in lot])
            for i in range(0, len(codes), AT_ONCE):
                part = slice(i, i + AT_ONCE)
                h = mix((codes[part].astype(np.uint64) << np.uint64(40)) ^ steps[part].astype(np.uint64))
                np.minimum.at(least, owner[part] * w.slots + (h >> np.uint64(57)).astype(np.int64) % w.slots, h & np.uint64((1 << 56) - 1))
            first = last
        out = (mix(least) % np.uint64(EMPTY)).astype(np.uint8)
        out[least == (1 << 56) - 1] = EMPTY
        return out.reshape(len(texts), w.slots)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of what two written sequences have in common, row by row, from the slots that agree."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    j = np.where(used > 0, same / np.maximum(used, 1), 1.0)
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def by_ranges(rows: DataFrame, parts: int) -> DataFrame:
    """Adds bucket: about ``parts`` ranges of ids, as even as their number asks for."""
    from pyspark.ml.feature import Bucketizer

    if isinstance(rows.schema["doc_id"].dataType, NumericType):
        steps = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
        exact = F.lit(max(10_000, 10 * parts))
        cuts = rows.select(F.percentile_approx(F.col("doc_id").cast("double"), F.array(*map(F.lit, steps)), exact).alias("c")).first()["c"] or [0.0]
        bucket = Bucketizer(splits=[float("-inf"), *sorted(set(cuts)), float("inf")], inputCol="_at", outputCol="bucket", handleInvalid="keep")
        place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
        return bucket.transform(rows.withColumn("_at", place)).drop("_at").withColumn("bucket", F.col("bucket").cast("int"))
    # Other ids are cut at some of a sample of bounded size.
    sample = sorted(r["doc_id"] for r in rows.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(20 * parts).collect())
    cuts = sorted(set(sample[20::20]))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(below).cast("int"))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, mark, doc_id, key, text), so that a sorted bucket holds runs of successive documents.

    Buckets are ranges of ids. The first document of a bucket is also sent, marked, to the end of the bucket before, and the
    very first one to the end of the last.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    rows = by_ranges(rows, parts)
    # One row per bucket.
    heads = [(r["bucket"], r["h"]["seen"], r["h"]["doc_id"], r["h"]["key"]) for r in rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("seen"), "doc_id", "key")).alias("h")).orderBy("bucket").collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = [(b, d, k, heads[i - 1][0]) for i, (b, _, d, k) in enumerate(heads)]
    small = docs.sparkSession.createDataFrame(table, f"_b int, _d {kind}, _k long, _before int")
    rows = rows.join(F.broadcast(small), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("mark"))
    copy = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("mark"))
    sent = rows.select("doc_id", "key", "text", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"))
    return sent.select("to.bucket", "to.mark", "doc_id", "key", "text")


def fingerprint(docs: DataFrame, w: Walk = Walk()) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string() if kind == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = Embedder(w)
        held: list[tuple] = []  # (bucket, doc_id, text, print or None): the last document waits for its successor

        def finish(lot: list[tuple], follow: list[tuple]) -> pa.RecordBatch:
            changed = [edited(x[2], y[2]) for x, y in zip(lot, follow, strict=True)]
            made = embed.prints([x[2] for x in lot] + [y[2] for y in follow[-1:]] + changed)
            m = len(lot)
            # Where the run breaks between buckets the successor's print isn't the next row.
            nxt = made[1 : m + 1].copy()
            for i in range(m - 1):
                if follow[i] is not lot[i + 1]:
                    nxt[i] = embed.prints([follow[i][2]])[0]
            other = made[m + 1 :]
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in lot], id_type), pa.array([len(x[2]) for x in lot], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array([r.tobytes().hex() for r in made[:m]], pa.string()), pa.array([r.tobytes().hex() for r in other], pa.string()), pa.array(likeness(made[:m], other), pa.float64()), pa.array(likeness(made[:m], nxt), pa.float64())], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        lot, follow, chars = [], [], 0
        last = None
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for bucket, mark, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True):
                    row = (bucket, doc, text)
                    if last is not None and last[0] == bucket:
                        lot.append(last)
                        follow.append(row)
                        chars += len(last[2]) + len(text)
                    last = None if mark else row  # a marked row only follows
                    if chars > 1 << 20:
                        yield finish(lot, follow)
                        lot, follow, chars = [], [], 0
        if lot:
            yield finish(lot, follow)

    dealt = with_next(docs, 4 * n).repartition(n, "bucket").sortWithinPartitions("bucket", "mark", F.col("doc_id").asc_nulls_first(), "key")
    return map_texts(dealt, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(prints: DataFrame, least: float = 0.8, bands: int = 24, per_band: int = 4, seed: int = 3, block: int = 512) -> DataFrame:
    """Links (a, b, likeness) of fingerprints that agree in all sampled slots of some band and reach ``least``: any two such
    fingerprints are linked, or joined by a chain of links.

    ``prints`` has id and fingerprint. Equal fingerprints stand for each other: they are linked to the least id that has
    them, and only distinct fingerprints are paired. In a band's bucket every member is first compared with the bucket's least and
    greatest id. In the buckets that these links leave in several components, all members of different components are then compared,
    in blocks of about ``block`` by ``block`` members; a block links components once.
    """
    rng = np.random.default_rng(seed)
    picks = [sorted(rng.choice(128, per_band, replace=False).tolist()) for _ in range(bands)]
    one = materialize(prints.groupBy("fingerprint").agg(F.min("id").alias("id")))
    copies = prints.join(one.withColumnRenamed("id", "a"), "fingerprint").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("likeness"))
    piece = lambda p: F.concat(*[F.substring("fingerprint", 2 * i + 1, 2) for i in p])
    keyed = one.select("id", F.explode(F.array(*[F.xxhash64(F.lit(k), piece(p)) for k, p in enumerate(picks)])).alias("key"))
    # Only keys that several have go on, and prints join only what is compared.
    heads = materialize(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"))
    keyed = materialize(keyed.join(heads, "key"))
    pairs = keyed.select(F.explode(F.array("lo", "hi")).alias("o"), "id").where("o <> id").select(F.least("o", "id").alias("a"), F.greatest("o", "id").alias("b")).distinct()
    side = lambda c: one.select(F.col("id").alias(c), F.col("fingerprint").alias(f"f{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.stack([np.frombuffer(bytes.fromhex(v), np.uint8) for v in b.column(c).to_pylist()]) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(likeness(x, y), pa.float64())], names=["a", "b", "likeness"])

    kind = prints.schema["id"].dataType.simpleString()
    found = f"a {kind}, b {kind}, likeness double"
    first = materialize(map_texts(pairs, verify, found).where(F.col("likeness") >= least))

    label = components(first.select("a", "b")).select(F.col("id").alias("_id"), "label")
    members = keyed.where("n > 2").join(label, F.col("id") == F.col("_id"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = members.join(mixed, "key").join(one, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "fingerprint", "label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(where: tuple, rows: list[tuple]) -> pa.RecordBatch:
            part, ids, texts, labels = zip(*rows, strict=True)
            print_of = np.stack([np.frombuffer(bytes.fromhex(t), np.uint8) for t in texts])
            side, out = np.array(part), []
            number = {x: k for k, x in enumerate(dict.fromkeys(labels))}
            of = np.array([number[x] for x in labels])
            for k in range(len(ids) - 1):
                apart = of[k + 1 :] != of[k]
                if where[1] != where[2]:
                    apart &= side[k + 1 :] != side[k]
                at = k + 1 + np.flatnonzero(apart)
                like = likeness(np.broadcast_to(print_of[k], (len(at), print_of.shape[1])), print_of[at])
                for m, v in zip(at[like >= least], like[like >= least], strict=True):
                    if of[m] != of[k]:
                        of[of == of[m]] = of[k]
                        out.append((min(ids[k], ids[m]), max(ids[k], ids[m]), float(v)))
            a, b, v = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type), pa.array(v, pa.float64())], names=["a", "b", "likeness"])

        where, rows = None, []
        id_type = None
        for batch in batches:
            id_type = batch.column(4).type
            for *at, part, i, text, own in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if tuple(at) != where and rows:
                    yield links(where, rows)
                    rows = []
                where = tuple(at)
                rows.append((part, i, text, own))
        if rows:
            yield links(where, rows)

    rest = map_texts(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id"), compare, found).dropDuplicates(["a", "b"])
    return first.unionByName(rest).unionByName(copies)


def near_documents(docs: DataFrame, w: Walk = Walk(), least: float = 0.8) -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id that near fingerprints reach from it, its own included) and n_links (how many
    verified links its text has). Likeness of ``least`` or more makes a link."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = Embedder(w)
        for b in batches:
            texts, lot, size = b.column(1), [], 0
            made = []
            for t in texts:  # so many characters at once as one embedding holds
                lot.append(t.as_py())
                size += len(lot[-1])
                if size > AT_ONCE:
                    made.extend(embed.prints(lot))
                    lot, size = [], 0
            made.extend(embed.prints(lot) if lot else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes().hex() for r in made], pa.string())], names=["doc_id", "fingerprint"])

    prints = materialize(map_texts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, f"doc_id {kind}, fingerprint string").withColumn("id", F.monotonically_increasing_id()))
    links = materialize(near_pairs(prints.select("id", "fingerprint"), least))
    label = components(links.select("a", "b")).withColumnRenamed("id", "_id")
    ends = links.select(F.explode(F.array("a", "b")).alias("_end")).groupBy("_end").agg(F.count(F.lit(1)).alias("n"))
    rows = prints.select("id", "doc_id").join(label, F.col("id") == F.col("_id"), "left").join(ends, F.col("id") == F.col("_end"), "left")
    rows = rows.select("doc_id", F.coalesce("label", "id").alias("label"), F.coalesce("n", F.lit(0)).alias("n_links"))
    class_of = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return rows.join(class_of, "label").select("doc_id", "class_id", "n_links")
