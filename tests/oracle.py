"""Runs a registered query and its SQL on the same tables and compares them."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return format(float(value), ".9g")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if not want:
        return "the SQL gives no rows"
    if got != want:
        lost = sorted(set(want) - set(got))[:3]
        extra = sorted(set(got) - set(want))[:3]
        return f"rows {len(got)} vs {len(want)}; only SQL {lost}; only Spark {extra}"
    return None


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from galley.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, fn, entry.oracle_sql().get(name))
        except Exception as error:  # report and go on to the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None
        mark = "ok " if verdict is None else "BAD"
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {verdict or ''}", flush=True)
    print("failures:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
