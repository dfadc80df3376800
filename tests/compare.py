"""Run registered queries next to their SQL: ``python tests/compare.py [sf] [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def rows(columns, values) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in values), key=repr)


def differences(spark_df, db, sql: str) -> str | None:
    """None if both sides have equal names, types and rows."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    expected = rows(names, result.fetchall())
    found = rows(spark_df.columns, (tuple(r) for r in spark_df.collect()))
    if found != expected:
        only_found = [r for r in found if r not in set(expected)][:3]
        only_expected = [r for r in expected if r not in set(found)][:3]
        return f"{len(found)} and {len(expected)} rows; only Spark {only_found}; only SQL {only_expected}"
    return None


def main() -> None:
    import tempfile

    from pyspark.sql import SparkSession

    from catalog.oracle import oracles
    from catalog.queries import QUERIES, Workspace
    from catalog.settings import Settings

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    settings = Settings()
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    db, sql = connect(sf_dir), oracles(settings)
    shared = Workspace(spark, sf_dir, settings)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            found = QUERIES[name](shared)
            n = found.count()
            spark_time, start = time.time() - start, time.time()
            problem = differences(found, db, sql[name])
            print(f"{'ok' if problem is None else 'DIFFERENT'} {name} rows={n} spark={spark_time:.1f}s "
                  f"check={time.time() - start:.1f}s {problem or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAILED {name}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
