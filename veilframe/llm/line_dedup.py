"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate and go from all texts but the first.

Lines are normalised (white space collapsed, trimmed, lower case) and hashed. HyperLogLog sketches of the sites of every line
merge by aggregation; where the estimate lies near the threshold, the distinct sites are counted exactly. Sites are counted over all
documents, copies included. A line that one text alone carries is not boilerplate, however often that text was copied: copies of
whole texts are left to a document-level operator. The text with the least doc_id among those that carry a spread line keeps it
in all its copies; all other texts lose it.

A line of at least ``min_words`` words spreads from ``min_sites`` sites on, a shorter one from ``short_min_sites`` on.

Edge cases: null and empty texts are returned as they are; lines without a word are never removed; a null source is a site of
its own; of rows that repeat a doc_id with other texts each is treated by its text; an empty table gives an empty result; the
other columns are returned unchanged, whatever their names (``n_chars`` follows the text where it is present, a column
named like the count is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import BROADCAST_ROWS, GAP, WORD, map_texts, materialize, numbered, small, text_key


@dataclass(frozen=True)
class Spread:
    min_sites: int = 3
    min_words: int = 5
    short_min_sites: int = 10
    sketch_bits: int = 10
    #: Estimates from threshold / near to threshold * near are counted exactly.
    near: float = 2.0


def line_hashes(text: Column) -> Column:
    """Distinct (hash, words) of the lines of a text that hold a word."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    tidy = F.transform(lines, lambda x: F.lower(F.btrim(F.regexp_replace(x, GAP, " "))))
    return F.array_distinct(F.transform(tidy, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w"))))


def spread_lines(docs: DataFrame, s: Spread = Spread()) -> tuple[DataFrame, DataFrame]:
    """The lines of the distinct texts (key, h, w, first, site) and the spread ones among them (h, sites, owner).

    ``first`` orders texts: the least doc_id of a text and its key. ``site`` is one of the text's sites.
    """
    site = F.coalesce(F.xxhash64("source", F.length("source")), F.lit(0)).alias("site")
    rows = docs.select("doc_id", site, text_key(F.col("text")).alias("key"), "text").where(F.col("text").isNotNull())
    held = materialize(rows.groupBy("key", "site").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("none")))
    least_id = F.min(F.struct((~F.col("none")).alias("named"), F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"))).alias("f")
    firsts = held.groupBy("key").agg(least_id, F.min("site").alias("site")).select("key", F.struct("f.doc_id", "key").alias("first"), "site")
    exploded = rows.select("key", F.explode(line_hashes(F.col("text"))).alias("x")).select("key", "x.h", "x.w").groupBy("key", "h").agg(F.first("w").alias("w"))
    lines = materialize(exploded.join(firsts, "key"))
    # The other sites of texts that stand on several.
    others = materialize(held.join(firsts.select("key", F.col("site").alias("_site")), "key").where("site <> _site").select("key", F.col("site").alias("other")))
    least = F.when(F.col("w") >= s.min_words, s.min_sites).otherwise(s.short_min_sites)
    everywhere = lines.select("h", "w", "first", "site").unionAll(lines.join(small(others), "key").select("h", "w", "first", F.col("other").alias("site")))
    sketched = everywhere.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(s.sketch_bits)).alias("sketch"), F.min("w").alias("w"), F.min("first").alias("owner"), F.max("first").alias("last"))
    likely = sketched.where("owner <> last").select("h", "owner", F.hll_sketch_estimate("sketch").alias("estimate"), least.alias("least")).where(F.col("estimate") * s.near >= F.col("least"))
    likely = materialize(likely)
    near = likely.where(F.col("estimate") <= F.col("least") * s.near)
    exact = everywhere.select("h", "site").join(small(near.select("h", "least")), "h").groupBy("h", "least", "site").agg(F.lit(1).alias("one")).groupBy("h", "least").agg(F.count("one").alias("sites")).where(F.col("sites") >= F.col("least")).select("h", "sites")
    sure = likely.where(F.col("estimate") > F.col("least") * s.near).select("h", F.col("estimate").alias("sites"))
    chosen = materialize(exact.unionAll(sure).join(likely.select("h", "owner"), "h"))
    return lines, small(chosen)


def dedup_lines(docs: DataFrame, s: Spread = Spread(), removed: str = "lines_removed") -> DataFrame:
    """The columns of ``docs`` with cleaned texts, and how many lines went (long) under the name ``removed``."""
    docs = docs.drop(removed)
    lines, spread = spread_lines(docs, s)
    gone = materialize(lines.join(spread, "h").where(F.col("first") != F.col("owner")).select("key", "h"))
    losers = gone.groupBy(F.col("key").alias("drop_key")).agg(F.collect_set("h").alias("drop"))  # a text's own lines at most
    if gone.count() <= BROADCAST_ROWS:
        losers = F.broadcast(losers)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    place = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for text, hashes, drop in zip(b.column(place), b.column(len(names)), b.column(len(names) + 1), strict=True):
                gone = set(drop.as_py() or ())
                if not gone:
                    texts.append(text.as_py())
                    counts.append(0)
                    continue
                every = text.as_py().split("\n")
                kept = [x for x, h in zip(every, hashes.as_py(), strict=True) if h not in gone]
                texts.append("\n".join(kept))
                counts.append(len(every) - len(kept))
            columns = list(b.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([old if n == 0 else len(t) for old, n, t in zip(columns[chars].to_pylist(), counts, texts, strict=True)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, removed])

    # The hashes of a text's lines, in order and with null for lines without a word, only where some line goes.
    rows, (text,) = numbered(docs, "text")
    ordered = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(WORD), F.xxhash64(F.lower(F.btrim(F.regexp_replace(x, GAP, " "))))))
    joined = rows.withColumn("row_key", text_key(text)).join(losers, F.col("row_key") == F.col("drop_key"), "left")
    return map_texts(joined.select(*rows.columns, F.when(F.col("drop").isNotNull(), ordered).alias("hashes"), "drop"), run, f"{kinds}, `{removed}` long")
