"""N-gram Jaccard join by parity sketches, and the components of its links.

Texts with equal shingle sets are one set. Every other set deals its shingles over the parts of an XOR sketch of its size band;
sets that reach the similarity must agree in one of the parts that both emit as keys (see ``parity``). The keys are counted with
partial aggregation, and those that a single set has are dropped. Candidates are then settled in an order that never writes
all pairs of a group:

1. Sets that share fewer keys than a link forces are dropped, and so are those whose shingles that no other candidate has are too
   many for any link: such shingles count fully towards every difference. Sets that only share a passage end here.
2. In every key's group each set is compared with the group's least set, and the links found are contracted to components.
3. Groups that lie in one component are done. In the others the differences to the least set bound those among the rest, as the
   symmetric difference is a metric, and sets that can't link any more are removed.
4. Pairs of different components that pass all bounds, the Hamming distance of finer bit sketches among them, are compared, each at the
   first key that it shares.

A comparison is exact, on whole texts. Texts travel to the comparisons in blocks of bounded size per least set, so one group of
copies, however large, is spread over many tasks. Small tables (counted first, up to ``broadcast_rows``) are broadcast, larger ones joined by
shuffle.

Edge cases: a null, empty or blank text has no shingles, links with nothing and is its own component; of fewer words than a shingle
the whole sequence is one; repeated rows are one set; a null doc_id takes its component's least id that isn't null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import BROADCAST_ROWS, map_texts, materialize, numbered, restored, small, text_key
from veilframe.llm.components import components
from veilframe.llm.parity import Bands, bit_sketch, folded, hamming
from veilframe.llm.shingles import Shingler


@dataclass(frozen=True)
class JoinSettings:
    words: int = 4
    percent: int = 85
    ratio: float = 1.6
    #: Texts that one task compares with a least set before the group continues in another block.
    block: int = 512
    #: Sets of a key's group, and bytes of their sketches, that one task holds of either side when all bounds are tried. A set travels once
    #: to every block of its group, so blocks are as large as memory allows.
    side: int = 8192
    side_bytes: int = 32 << 20
    broadcast_rows: int = BROADCAST_ROWS

    @property
    def bands(self) -> Bands:
        return Bands(self.percent, self.ratio)

    def differ(self, a: Column, b: Column) -> Column:
        """Most elements in which linked sets of these sizes differ."""
        return F.floor((100 - self.percent) * (a + b) / F.lit(100 + self.percent) + 1e-9).cast("long")

    def most(self, n: Column) -> Column:
        return F.floor(100 * n / F.lit(self.percent) + 1e-9).cast("long")


def sketch(docs: DataFrame, s: JoinSettings) -> DataFrame:
    """Per row: doc_id, key of the text, set size n, two checksums of the set, and its sketch keys."""
    bands = s.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows, keys = [], []
                for x in shingler.sets(part.column(2).to_pylist()):
                    rows.append((len(x), int(np.bitwise_xor.reduce(x).view(np.int64)) if len(x) else 0, int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0))
                    keys.append(bands.keys(x))
                n, s1, s2 = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, s1, s2, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], names=["doc_id", "tk", "n", "s1", "s2", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text"), run, f"doc_id {kind}, tk long, n long, s1 long, s2 long, keys array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame, s: JoinSettings) -> DataFrame:
    """The rows of ``wanted`` (with _doc and _tk) beside the text of the document that they name."""
    rows = docs.select("doc_id", "text").withColumn("tk", text_key(F.col("text")))
    return rows.join(small(wanted, s.broadcast_rows), (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("doc_id", "tk", "_doc", "_tk")


def compare(docs: DataFrame, pairs: DataFrame, sets: DataFrame, s: JoinSettings) -> DataFrame:
    """Exact symmetric differences: (a, b, na, nb, delta) of distinct pairs (a, b) of set ids."""
    blocks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("blocks"))
    left = pairs.join(blocks, "b").select(F.col("a").alias("sid"), "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"))
    right = blocks.select(F.col("b").alias("sid"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"))
    routes = materialize(left.unionByName(right).join(sets.select("sid", "n", F.col("doc").alias("_doc"), F.col("tk").alias("_tk")), "sid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        head, whose, last = np.empty(0, np.uint64), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                sid, b, block, role, n = (part.column(i).to_pylist() for i in range(5))
                for k, x in enumerate(shingler.sets(part.column(5).to_pylist())):
                    if len(x) != n[k]:
                        continue  # another text under the same key
                    if role[k] == 0:
                        head, whose = x, (b[k], block[k])
                    elif whose == (b[k], block[k]) and last != (sid[k], b[k]):
                        found = np.searchsorted(head, x)
                        same = int((head[np.minimum(found, len(head) - 1)] == x).sum())
                        out.append((sid[k], b[k], len(x), len(head), len(x) + len(head) - 2 * same))
                        last = (sid[k], b[k])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "na", "nb", "delta"])

    routed = texts_of(docs, routes, s).select("sid", "b", "block", "role", "n", "text")
    return map_texts(routed.repartition("b", "block").sortWithinPartitions("b", "block", "role", "sid"), run, "a long, b long, na long, nb long, delta long")


def links_of(compared: DataFrame, s: JoinSettings) -> DataFrame:
    return compared.where(100 * (F.col("na") + F.col("nb") - F.col("delta")) >= s.percent * (F.col("na") + F.col("nb") + F.col("delta"))).select("a", "b")


def likely(pairs: DataFrame, cands: DataFrame, s: JoinSettings) -> DataFrame:
    """The pairs whose sizes allow a link and that share as many keys as a link forces."""
    bands = s.bands
    side = lambda c: cands.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"k{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [shared(bands, na, nb, np.array(ka), np.array(kb)) is not None for na, nb, ka, kb in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_texts(rows.select("a", "b", "na", "nb", "ka", "kb"), run, "a long, b long")


def shared(bands: Bands, na: int, nb: int, ka: np.ndarray, kb: np.ndarray) -> int | None:
    """The least key that two sets share, or None if they share fewer keys than linked sets must."""
    both = np.intersect1d(ka, kb, assume_unique=True)
    return int(both[0]) if len(both) >= max(1, bands.need(na, nb)) else None


def prune(rows: DataFrame, more: Column, least: Column, s: JoinSettings) -> DataFrame:
    """Drops rows of a key's group that no other row can reach: ``more`` + the least of ``least`` in the group lower-bounds
    every difference. Only aggregates by key move between tasks, pre-aggregated."""
    for _ in range(2):
        of = rows.groupBy("key").agg(F.min(least).alias("_low"), F.max("n").alias("_top"), F.min("sid").alias("_s1"), F.max("sid").alias("_s2")).where("_s1 <> _s2")
        rows = rows.join(of, "key").where(more + F.col("_low") <= s.differ(F.col("n"), F.least("_top", s.most(F.col("n"))))).drop("_low", "_top", "_s1", "_s2")
    return rows


def open_groups(rows: DataFrame) -> DataFrame:
    """The rows of groups that hold several components."""
    several = rows.groupBy("key").agg(F.min("comp").alias("_c1"), F.max("comp").alias("_c2")).where("_c1 <> _c2").select("key")
    return materialize(rows.join(several, "key"))


def remaining_pairs(rows: DataFrame, sketches: DataFrame, s: JoinSettings) -> DataFrame:
    """Pairs of different components in a key's group that pass every bound, each at the first key that both sets have. A group is
    dealt over pairs of blocks of about ``side`` sets or ``side_bytes`` bytes. ``sketches`` has a set's keys and bit sketch, which join
    the rows when these have been dealt, and so move once."""
    bands = s.bands

    def pairs(key: int, one_block: bool, group: list[tuple]) -> Iterator[tuple[int, int]]:
        sid, n, u, delta, comp, part = (np.array(c, np.int64) for c in zip(*[x[:6] for x in group], strict=True))
        keys = [x[7] for x in group]
        bits = folded([x[6] for x in group])
        far = 2 * u - delta
        share = 100 + s.percent
        for i in range(1, len(group)):
            limit = (100 - s.percent) * (n[i] + n[:i])
            fits = (comp[:i] != comp[i]) & (share * (u[i] + u[:i]) <= limit) & (share * (delta[i] + far[:i]) <= limit) & (share * (delta[:i] + far[i]) <= limit)
            fits &= 100 * np.minimum(n[:i], n[i]) >= s.percent * np.maximum(n[:i], n[i])
            if not one_block:
                fits &= part[:i] != part[i]
            near = np.flatnonzero(fits)
            near = near[share * hamming(bits[i], bits[near]) <= limit[near]]
            for j in near:
                if shared(bands, int(n[i]), int(n[j]), keys[i], keys[j]) == key:
                    yield int(max(sid[i], sid[j])), int(min(sid[i], sid[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(at: tuple[int, int, int], group: list[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int]] = []
            for p in pairs(at[0], at[1] == at[2], group):
                out.append(p)
                if len(out) == 10000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

        at, group = None, []
        for b in batches:
            lists = b.column(10)  # keys stay numbers, not objects
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            own = [flat[a:z].copy() for a, z in zip(ends[:-1], ends[1:], strict=True)]
            for k, i, j, *x in zip(*(b.column(c).to_pylist() for c in range(10)), own, strict=True):
                if (k, i, j) != at and group:
                    yield from emit(at, group)
                    group = []
                at = (k, i, j)
                group.append(x)
        if group:
            yield from emit(at, group)

    # A set's sketches take about five bytes per element.
    size = F.greatest(F.ceil(F.count(F.lit(1)) / s.side), F.ceil(F.sum(5 * F.col("n") + 64) / s.side_bytes))
    parts = rows.groupBy("key").agg(size.cast("int").alias("parts"))
    dealt = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "sid", "n", "u", "delta", "comp", "part")
    dealt = dealt.join(small(sketches, s.broadcast_rows), "sid").select("key", "i", "j", "sid", "n", "u", "delta", "comp", "part", "bits", "keys")
    return map_texts(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sid"), run, "a long, b long")


def unique_shingles(docs: DataFrame, sets: DataFrame, s: JoinSettings, every: int) -> DataFrame:
    """(sid, u): how many shingles of each of the sets no other of them has, at least. With ``every`` above 1 only so many of the
    hashes are counted: a bound from half of the shingles is as valid and settles most sets at half the cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [x[x % np.uint64(every) == 0] for x in shingler.sets(part.column(1).to_pylist())]
                owner = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found).view(np.int64))], names=["sid", "h"])

    texts = texts_of(docs, sets.select("sid", F.col("doc").alias("_doc"), F.col("tk").alias("_tk")), s).select("sid", "text")
    # Nearly all hashes differ, so a partial aggregation would only widen what moves.
    alone = map_texts(texts, run, "sid long, h long").repartition("h").groupBy("h").agg(F.min("sid").alias("sid"), F.max("sid").alias("_other")).where("sid = _other")
    return alone.groupBy("sid").agg(F.count(F.lit(1)).alias("u"))


def bit_sketches(docs: DataFrame, sets: DataFrame, s: JoinSettings) -> DataFrame:
    """(sid, bits): the bit sketch of each of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bit_sketch(x) for x in shingler.sets(part.column(1).to_pylist())], pa.binary())], names=["sid", "bits"])

    wanted = materialize(sets.select("sid", F.col("doc").alias("_doc"), F.col("tk").alias("_tk")))
    return map_texts(texts_of(docs, wanted, s).select("sid", "text"), run, "sid long, bits binary").dropDuplicates(["sid"])


def find_links(docs: DataFrame, sets: DataFrame, keyed: DataFrame, s: JoinSettings) -> DataFrame | None:
    """(id, label) of the sets that have links; None if no two sets share enough keys."""
    # Counted with partial sums; joined by shuffle at every size, where a key of many sets can be split over tasks.
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    members = materialize(keyed.join(common, "key"))
    own = members.groupBy("sid").agg(F.collect_list("key").alias("keys"))  # a set's own keys at most
    # A set that shares fewer keys than a link forces has none.
    shares = (F.col("n") < s.bands.sure) | (F.size("keys") > s.bands.spare)
    cands = materialize(sets.join(own, "sid").where(shares).select("sid", "n", "doc", "tk", F.sort_array("keys").alias("keys")))
    if cands.isEmpty():
        return None
    # Sets that share a passage but have too much of their own go before anything is compared.
    counted = materialize(cands.select("sid", "n", "doc", "tk").join(unique_shingles(docs, cands, s, 2), "sid", "left").withColumn("u", F.coalesce("u", F.lit(0))).where(F.col("u") <= s.differ(F.col("n"), s.most(F.col("n")))))
    members = members.join(small(counted.select("sid", "n", "u"), s.broadcast_rows), "sid")
    members = prune(members, F.col("u"), F.col("u"), s)
    members = materialize(members.join(members.groupBy("key").agg(F.min("sid").alias("p")), "key"))
    first = materialize(likely(members.where("sid <> p").select(F.col("sid").alias("a"), F.col("p").alias("b")).distinct(), cands, s))
    compared = materialize(compare(docs, first, cands, s))
    links = links_of(compared, s)
    labels = components(links)
    rows = members.where("sid <> p").join(labels.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("label", "sid")).drop("label")
    rows = open_groups(rows)
    if rows.isEmpty():
        return labels
    # Few sets are left: all of their shingles are counted. The least sets are among them, so what is unique is not in those.
    hot = materialize(rows.select("sid").unionAll(rows.select("p")).distinct().join(cands, "sid"))
    alone = unique_shingles(docs, hot, s, 1)
    rows = rows.drop("u").join(alone, "sid", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    rows = open_groups(prune(rows, F.col("u"), F.col("u"), s))
    known = compared.select(F.col("a").alias("sid"), F.col("b").alias("p"), "delta")
    # Pairs with the least set that could be told apart without comparing them still need their difference as a bound.
    lack = materialize(rows.select("sid", "p").distinct().join(known, ["sid", "p"], "left_anti").select(F.col("sid").alias("a"), F.col("p").alias("b")))
    if not lack.isEmpty():
        known = known.unionByName(compare(docs, lack, cands, s).select(F.col("a").alias("sid"), F.col("b").alias("p"), "delta"))
    rows = open_groups(prune(rows.join(known, ["sid", "p"]), F.col("delta"), 2 * F.col("u") - F.col("delta"), s))
    sketches = materialize(bit_sketches(docs, rows.select("sid").distinct().join(cands, "sid"), s).join(cands.select("sid", "keys"), "sid"))
    rest = materialize(remaining_pairs(rows, sketches, s))
    if rest.isEmpty():
        return labels
    return components(links.unionByName(links_of(compare(docs, rest, cands, s), s)))


def join_components(docs: DataFrame, s: JoinSettings = JoinSettings()) -> DataFrame:
    """Per row: doc_id, tk (key of the text), n_shingles, component_id, stays (whether it is the component's first text; of
    repeated rows all are)."""
    sk = materialize(sketch(docs, s).withColumn("rid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("first")
    sets = materialize(sk.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("rid").alias("sid"), first, F.min_by("tk", "rid").alias("tk"), F.min_by("doc_id", "rid").alias("doc")))
    keyed = sk.join(small(sets.select("sid"), s.broadcast_rows), F.col("rid") == F.col("sid"), "left_semi").select(F.col("rid").alias("sid"), F.explode("keys").alias("key"))
    labels = find_links(docs, sets, keyed, s)
    result = sets.select("n", "s1", "s2", "sid", "first")
    if labels is not None:
        named = sets.select("sid", "first").join(labels.withColumnRenamed("id", "sid"), "sid")
        least = named.groupBy("label").agg(F.min("first").alias("_least"))
        result = result.join(named.join(least, "label").select("sid", "_least"), "sid", "left").withColumn("first", F.coalesce("_least", "first")).drop("_least")
    result = materialize(result.select("n", "s1", "s2", F.col("first.doc_id").alias("_id"), F.col("first.tk").alias("_tk")))
    joined = sk.select("doc_id", "tk", "n", "s1", "s2").join(small(result, s.broadcast_rows), ["n", "s1", "s2"], "left")
    alone = F.col("n") == 0
    return joined.select("doc_id", "tk", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("_id")).alias("component_id"), (alone | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")))).alias("stays"))


def keep_first(docs: DataFrame, s: JoinSettings = JoinSettings()) -> DataFrame:
    """The rows of ``docs`` less all but the first document of every component. Texts without shingles stay. Columns of any name pass."""
    found = materialize(join_components(docs, s).select("doc_id", "tk", "n_shingles", "stays"))
    rows, (doc, text) = numbered(docs, "doc_id", "text")
    rows = rows.withColumn("row_key", text_key(text))
    on = doc.eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("tk"))
    gone = materialize(found.where("not stays").select("doc_id", "tk").distinct())
    kept = rows.join(small(gone, s.broadcast_rows), on, "left_anti")
    again = materialize(found.where("stays and n_shingles > 0").groupBy("doc_id", "tk").count().where("count > 1").select("doc_id", "tk"))
    if not again.isEmpty():  # repeated rows of a document that stays: one of them does
        again = small(again, s.broadcast_rows)
        one = kept.join(again, on, "left_semi").dropDuplicates([f"#{docs.columns.index('doc_id')}", "row_key"])
        kept = kept.join(again, on, "left_anti").unionByName(one)
    return restored(kept, docs.columns)
