"""Compare registered queries with their SQL twins: python -m catalog.check sf_dir [prefix…]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from rolesift.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> "duckdb.DuckDBPyConnection":
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, key: str, query, oracle: str | None, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "PLAN has a cross join"
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    if oracle is None:
        return f"rows {len(got)}"
    cur = con.execute(oracle)
    want_cols, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"COLUMNS differ: {sorted(got_cols)} vs {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a == b:
        return f"ok {len(a)}" + ("" if a else " EMPTY")
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"DIFF {len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}"


def main() -> None:
    from catalog import ORACLES, QUERIES
    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for key, query in QUERIES.items():
        if prefixes and not key.startswith(prefixes):
            continue
        start = time.time()
        try:
            result = compare(spark, con, key, query, ORACLES.get(key), sf_dir)
        except Exception as exc:
            result = f"FAIL {type(exc).__name__}: {str(exc)[:600]}"
        bad += not result.startswith(("ok", "rows"))
        if not result.startswith("ok") or time.time() - start > 4:
            print(f"{key}: {result} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(QUERIES)} queries, {bad} not matching")
    spark.stop()


if __name__ == "__main__":
    main()
