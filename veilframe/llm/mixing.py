"""Mixes sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

Documents fall into blocks of their source by a seeded hash, which permutes them. The target of a source fixes how often all its
blocks are taken and how many blocks, in permuted order, are taken once more; one block is taken in part. These block quotas,
one number per source, are split down a binary tree over the output shards, each split a multivariate hypergeometric draw,
so every shard gets a fair share of every source and the quotas add up exactly. A shard draws the next blocks of each source,
disjoint from the others', and orders their documents by a seeded hash. What a document contributes is what shards have drawn of
its block: nothing is taken that the tree doesn't hand to a shard.

The driver holds a few numbers per source (a source is a line of the mix) and shard; documents stay in the executors, and no
task holds more than one block of a source, about ``block_docs`` documents.

Edge cases: a null source is one of its own, the last; a null or blank text has size 0, adds nothing to what is taken
and comes as often as its block; a source without
words has target 0; rows that repeat id, source and text are rows of their own, spread over the blocks, and may differ in what is taken; a
null id is an id; an empty table gives an empty result; columns of any name pass through ``mix_rows``, but ``mix_shard`` and
``mix_order`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import materialize, numbered, restored, small, text_key, words


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in the order of their names; no source is taken more than ``most_times`` its size. There are
    ``shards`` shards, or, where it is 0, one per ``shard_words`` words and eight at least."""

    weights: tuple[int, ...] = (1, 2, 3)
    most_times: int = 3
    shards: int = 0
    shard_words: int = 2_000_000_000
    block_docs: int = 4096
    #: So many blocks are summed first where a source's blocks are summed up in order.
    run: int = 1024
    seed: int = 17


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """What each source gives of the sum of the sizes: shares by weight, stopped at most_times the size, the excess reshared."""
    total, weights = sum(sizes), [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    # A source stops where the common level reaches its cap per weight; those with the least caps stop first.
    order = sorted(range(len(sizes)), key=lambda i: mix.most_times * sizes[i] / weights[i])
    found, left, weight = [0.0] * len(sizes), total, sum(weights)
    for k, i in enumerate(order):
        if left * weights[i] <= mix.most_times * sizes[i] * weight:
            for j in order[k:]:
                found[j] = left * weights[j] / weight
            break
        found[i] = float(mix.most_times * sizes[i])
        left, weight = left - mix.most_times * sizes[i], weight - weights[i]
    return found


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Per shard and source, how many blocks: draws down a binary tree whose leaves hold equal numbers of blocks, or one more."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def descend(have: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = have
            return
        half = n // 2
        taken = rng.multivariate_hypergeometric(have, int(have.sum()) * half // n, method="marginals")
        descend(taken, first, half)
        descend(have - taken, first + half, n - half)

    if quotas:
        descend(np.array(quotas, np.int64), 0, shards)
    return out


def fill(size: np.ndarray, room: int) -> np.ndarray:
    """Of one block: which documents are taken, in order while they fit, then smaller ones into what is left."""
    chosen = np.cumsum(size) <= room
    room -= int(size[chosen].sum())
    for i in sorted(np.flatnonzero(~chosen & (size <= room)), key=lambda i: -size[i]):
        if size[i] <= room:
            chosen[i] = True
            room -= int(size[i])
    # One document more if that comes nearer to the target than staying below it.
    rest = [i for i in np.flatnonzero(~chosen) if size[i] < 2 * room]
    if rest:
        chosen[min(rest, key=lambda i: (abs(int(size[i]) - room), i))] = True
    return chosen


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come one after the other, sorted; each is about block_docs rows of numbers."""
    whose, rows = None, []

    def done() -> pa.RecordBatch:
        size = np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(fill(size, rows[0][2]), pa.bool_())], names=["row", "extra"])

    for b in batches:
        for i, *r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if i != whose and rows:
                yield done()
                rows = []
            whose = i
            rows.append(r)
    if rows:
        yield done()


def assign(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row: doc_id, source, key of the text, again (its number among rows that repeat these), same (how many these are), size,
    source_size, target, copies, taken, shards and orders (one per copy): where a copy stands is its order's place among its shard's."""
    own = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), text_key(F.col("text")).alias("key"))
    # Rows that repeat are counted, then dealt by their number, so they don't meet in one block.
    own = own.groupBy("doc_id", "source", "key").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("same"))
    own = materialize(own)  # from here on, sizes are fixed
    per = [(r["source"], r["n"], r["words"]) for r in own.groupBy("source").agg(F.sum("same").alias("n"), F.sum(F.col("size") * F.col("same")).alias("words")).collect()]
    per.sort(key=lambda r: (r[0] is None, r[0] or ""))  # Python orders strings by code point
    goal = targets([w for _, _, w in per], mix)
    spark = docs.sparkSession
    rows = []
    for i, (source, n, size) in enumerate(per):
        times = min(mix.most_times, int(goal[i] // size)) if size else 0
        rows.append((source, i, size, goal[i], times, max(0, round(goal[i]) - times * size) if size and times < mix.most_times else 0, -(-n // mix.block_docs)))
    # One row per source.
    plan = spark.createDataFrame(rows, "source string, _i int, source_size long, target double, times int, over long, blocks long")
    own = own.join(F.broadcast(plan.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    own = own.withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1)))
    own = own.withColumn("draw", F.xxhash64(F.lit(mix.seed), "doc_id", "key", "again"))
    own = own.withColumn("block", F.pmod(F.xxhash64("draw", F.lit(mix.seed)), F.col("blocks")))
    # In which block a source's target falls: sums over runs of blocks in order, then inside the runs.
    sums = own.where("over > 0").groupBy("_i", "block", "over").agg(F.sum("size").alias("words")).withColumn("run", F.floor(F.col("block") / mix.run))
    runs = sums.groupBy("_i", "run").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("_i").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_i", "run", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("_i", "run").orderBy("block"))
    cuts = sums.join(runs, ["_i", "run"]).withColumn("upto", upto).where("upto > over").groupBy("_i").agg(F.min(F.struct("block", F.expr("over - (upto - words)").alias("room"))).alias("c"))
    cuts = {r["_i"]: (r["c"]["block"], r["c"]["room"]) for r in cuts.collect()}  # one row per source
    quotas = [times * blocks + (cuts.get(i, (blocks - 1, 0))[0] + 1 if over else 0) for _, i, _, _, times, over, blocks in rows]
    shards = mix.shards or max(8, -(-sum(w for _, _, w in per) // mix.shard_words))
    ends = split_quotas(quotas, shards, mix.seed).cumsum(0) if rows else np.zeros((0, 0), np.int64)
    # The numbers that shard k draws of a source follow those of shard k - 1. Number n is block n % blocks, taken for the (n // blocks)th time.
    drawn = [(i, k, int(ends[k - 1][i]) if k else 0, int(ends[k][i])) for k in range(len(ends)) for i in range(len(rows))]
    drawn = spark.createDataFrame([x for x in drawn if x[2] < x[3]], "_i int, shard int, first long, last long").join(F.broadcast(plan.select("_i", "blocks")), "_i")
    drawn = drawn.withColumn("n", F.explode(F.expr("sequence(first, last - 1)"))).select("_i", F.expr("n % blocks").alias("block"), F.struct(F.expr("cast(n div blocks as int)").alias("time"), "shard").alias("copy"))
    # A block is drawn most_times times at most.
    drawn = materialize(drawn.groupBy("_i", "block").agg(F.sort_array(F.collect_list("copy")).alias("drawn")))
    own = own.join(small(drawn), ["_i", "block"], "left")
    cut = spark.createDataFrame([(i, *(cuts.get(i, (rows[i][6], 0)))) for i in range(len(rows))], "_i int, cut long, room long")
    own = own.join(F.broadcast(cut), "_i")
    # Only the block in which a source's target falls is looked at document by document.
    part = own.where("over > 0 and block = cut").select("_i", "doc_id", "source", "key", "again", "draw", "size", "room").withColumn("row", F.monotonically_increasing_id())
    part = materialize(part.repartition("_i").sortWithinPartitions("_i", "draw", "doc_id", "key", "again"))
    chosen = part.select("_i", "row", "size", "room").mapInArrow(_filled, "row long, extra boolean").where("extra")
    # Of one block per source.
    chosen = materialize(part.join(chosen, "row").select(F.col("_i").alias("_ci"), F.col("draw").alias("_cd"), F.col("doc_id").alias("_cid"), F.col("key").alias("_ck"), F.col("again").alias("_ca"), F.lit(True).alias("extra")))
    same = (F.col("_i") == F.col("_ci")) & (F.col("draw") == F.col("_cd")) & F.col("doc_id").eqNullSafe(F.col("_cid")) & (F.col("key").eqNullSafe(F.col("_ck"))) & (F.col("again") == F.col("_ca"))
    own = own.join(small(chosen), same, "left")
    taken = F.expr("filter(coalesce(drawn, array()), x -> x.time < times or block <> cut or extra is not null)")
    own = own.withColumn("took", taken).withColumn("copies", F.size("took"))
    order = F.expr(f"transform(took, x -> xxhash64({mix.seed}, doc_id, x.time, key, again))")
    return own.select("doc_id", "source", "key", "again", "same", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("took.shard").alias("shards"), order.alias("orders"))


def mix_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, once per copy, with shard and position key; sort by both to read a shard."""
    found = _mixed(docs, mix)[0].withColumns({"mix_shard": F.col("at.mix_shard"), "mix_order": F.col("at.mix_order")})
    return restored(found, docs.columns, "mix_shard", "mix_order")


def mix_in_order(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus shard after shard, each shuffled: the columns of ``docs``."""
    found, shards = _mixed(docs, mix)
    return restored(shuffle_shards(found, shards, "at.mix_shard", "at.mix_order"), docs.columns)


def _mixed(docs: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    got = materialize(assign(docs, mix).where("copies > 0").select("doc_id", "source", "key", "same", F.arrays_zip(F.col("shards").alias("mix_shard"), F.col("orders").alias("mix_order")).alias("at")))
    rows, (doc, source, text) = numbered(docs, "doc_id", "source", "text")
    rows = rows.withColumn("row_key", text_key(text))
    on = doc.eqNullSafe(F.col("doc_id")) & source.eqNullSafe(F.col("source")) & (F.col("row_key") == F.col("key"))
    found = rows.join(small(got.where("same = 1")), on).select(*rows.columns, F.explode("at").alias("at"))
    many = got.where("same > 1")
    if not many.isEmpty():  # of rows that repeat, one carries the copies of all
        copies = materialize(many.select("doc_id", "source", "key", F.explode("at").alias("at")))
        names = materialize(many.select("doc_id", "source", "key").distinct())
        one = rows.join(small(names), on, "left_semi").dropDuplicates([*(f"#{docs.columns.index(c)}" for c in ("doc_id", "source")), "row_key"])
        found = found.unionByName(one.join(small(copies), on).select(*rows.columns, "at"))
    shards = (got.agg(F.max(F.array_max("at.mix_shard"))).first()[0] or 0) + 1
    return found, shards


def shuffle_shards(mixed: DataFrame, shards: int | None = None, shard: str = "mix_shard", order: str = "mix_order") -> DataFrame:
    """Shard after shard, each shuffled by the position key: its range is cut evenly, so that a shard is several tasks, in order."""
    shards = shards or (mixed.agg(F.max(shard)).first()[0] or 0) + 1
    parts = -(-int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    part = F.least(F.floor((F.col(order).cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1))
    return mixed.repartitionById(shards * parts, (F.col(shard) * parts + part).cast("int")).sortWithinPartitions(shard, order)


def coarse_error(taken: Iterator[int], target: float) -> float:
    """Relative distance of a source's taken words from its target; for tests and reports."""
    got = sum(taken)
    return math.inf if not target and got else abs(got - target) / target if target else 0.0
