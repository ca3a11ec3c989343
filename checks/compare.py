"""Run registered queries next to their SQL and compare all rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from veedor.plans.queries import QUERIES
from veedor.runtime import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canon(df: pd.DataFrame) -> list[str]:
    df = df.reindex(sorted(df.columns), axis=1)
    text = pd.DataFrame({c: df[c].map(lambda v: "" if pd.isna(v) else str(v)) for c in df.columns})
    return sorted("|".join(row) for row in text.itertuples(index=False))


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty when both hold the same rows under the same column names."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    mine, theirs = _canon(spark_rows), _canon(sql_rows)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    kinds = {
        c: (spark_rows[c].dtype.kind, sql_rows[c].dtype.kind)
        for c in spark_rows.columns
        if spark_rows[c].dtype.kind != sql_rows[c].dtype.kind
    }
    return f"{len(wrong)} rows differ, types {kinds}, first {wrong[0]}" if wrong else ""


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            rows = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in ORACLES:
                result = difference(rows, con.execute(ORACLES[name]).df())
            else:
                result = "" if len(rows) else "no rows"
        except Exception as error:  # report and go on with the next query
            took, rows, result = time.time() - start, [], f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(result)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if result else 'ok'}  {name:28s} {kind:4s} {len(rows):7d} rows {took:6.2f}s {result}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
