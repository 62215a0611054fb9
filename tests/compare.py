"""Runs registered queries beside their SQL: python -m tests.compare SF_DIR [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return "" if x is None else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, name, query, sql, sf_dir):
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    ours, ours_names = canonical([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs, theirs_names = canonical(result.fetchall(), names)
    if ours_names != theirs_names:
        return f"columns {ours_names} and {theirs_names}"
    if ours != theirs:
        a, b = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
        return f"{len(ours)} and {len(theirs)} rows; only ours {a}; only SQL {b}"
    return None


def main(sf_dir, *names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            said = compare(spark, name, queries[name], oracle[name], sf_dir) if name in oracle else f"(rows only) {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # the report goes on with the next query
            said = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if said and not said.startswith("(rows"):
            bad += 1
        print(f"{name}: {said or 'ok'} [{time.time() - began:.1f}s]", flush=True)
    print("differing:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
