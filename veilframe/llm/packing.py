"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

A piece is never longer than a sequence, so all that best-fit decreasing needs to know is how many pieces there are of each
length: at most ``capacity`` counts. A segment tree over the remaining capacities finds the tightest open bin in logarithmic
time; equal pieces go into equal bins together, so the plan costs the same for a thousand pieces as for a trillion. The plan
is a list of runs: pieces of a length, from a rank on, go into bins from a number on, at an offset. A piece then finds its
place from its length and its rank among the pieces of that length, which comes from counts per salted bucket of a length
plus a rank inside the bucket. Neither pieces nor documents meet in one task or on the driver.

Edge cases: a null text is empty and gives one piece that holds id 0; repeated rows are packed each; equal pieces may swap
places between runs of the job but never share one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import map_texts, materialize

CAPACITY = 2048
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities; a leaf says whether some open bin has that capacity left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, at: int, present: bool) -> None:
        at += self.size
        self.any[at] = present
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that some bin has left."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks from ``rank`` on: ``each`` of them per bin, in bins from ``bin`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing of so many pieces of each length. A new bin opens only when no open one has room."""
    tree, left, runs, opened = CapacityTree(capacity), defaultdict(list), [], 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            left[room].append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                full, over = divmod(rest, each)
                runs.append(Run(length, rank, rest, opened, each, 0))
                add(capacity - each * length, opened, full)
                if over:
                    add(capacity - over * length, opened + full, 1)
                opened, rest = opened + full + bool(over), 0
            else:
                first, n = left[room].pop()
                # One after the other: a bin that still is the tightest takes the next piece too.
                each = room // length
                used = min(n, -(-rest // each))
                placed = min(rest, used * each)
                runs.append(Run(length, rank, placed, first, each, capacity - room))
                full, over = divmod(placed, each)
                add(room - each * length, first, full)
                if over:
                    add(room - over * length, first + full, 1)
                if n > used:
                    left[room].append((first + used, n - used))
                tree.put(room, bool(left[room]))
                rank, rest = rank + placed, rest - placed
    return runs


def tokenizer():
    """The public byte-level BPE, by its ranks: the same ids as its tokenizers file, in a quarter of the time. The string of an
    added token is that token, and the text between is encoded by ranks."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes what doesn't fill a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def tokenize(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(tokenizer().encode, allowed_special="all")
        for b in batches:
            own, rows = [], []
            for k, text in enumerate(b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                for i, (at, n) in enumerate(cut(len(ids), capacity)):
                    own.append(k)
                    rows.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select("doc_id", "text"), run, PIECES.format(kind=kind))


def rank_by_length(pieces: DataFrame) -> DataFrame:
    """Adds rank: a number from 0 on among the pieces of the same length, without gaps."""
    spark = pieces.sparkSession
    # A length that holds a third of all pieces is spread over as many buckets as there are shuffle partitions.
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))))).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_k", F.row_number().over(inside)).join(sizes, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_k") - 1).drop("_salt", "_k", "_before")


def place(pieces: DataFrame, runs: list[Run]) -> DataFrame:
    """Adds sequence_id and offset from length and rank."""
    # The plan's size is bounded by the capacity, not by the data.
    table = np.array([(r.length, r.rank, r.bin, r.each, r.offset) for r in sorted(runs, key=lambda r: (r.length, r.rank))], np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]
    schema = pieces.drop("rank").schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(at[:, 2] + k // at[:, 3]), pa.array(at[:, 4] + k % at[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_texts(pieces, run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenize(docs, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    placed = place(rank_by_length(pieces), plan(counts, capacity))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def reference_bins(lengths: list[int], capacity: int = CAPACITY) -> int:
    """How many bins plain best-fit decreasing opens; for tests."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        rooms.insert(bisect_left(rooms, room - n), room - n)
    return len(rooms)
