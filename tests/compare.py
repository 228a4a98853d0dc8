"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, str(_plain(v))) for k, v in value.asDict().items()))
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def spark_rows(df):
    return _normal(df.columns, df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    return _normal([d[0] for d in cursor.description], cursor.fetchall())


def difference(spark_result, sql_result) -> str | None:
    (names, rows), (sql_names, expected) = spark_result, sql_result
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if len(rows) != len(expected):
        only = list(set(map(repr, rows)) - set(map(repr, expected)))[:2]
        missing = list(set(map(repr, expected)) - set(map(repr, rows)))[:2]
        return f"{len(rows)} rows != {len(expected)}; spark only {only}; sql only {missing}"
    for got, want in zip(rows, expected):
        if got != want:
            cells = [(n, a, b) for n, a, b in zip(names, got, want) if a != b]
            return f"{cells[:4]} in {got}"
    return None


def main(sf_dir: str, wanted: list[str]) -> int:
    from lowtide.checks import REGISTRY
    from lowtide.session import local_session

    spark, con, bad = local_session(8), connect(sf_dir), 0
    names = [n for n in REGISTRY if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    for name in names:
        q, started = REGISTRY[name], time.time()
        try:
            got = spark_rows(q.run(spark, sf_dir))
            seconds = time.time() - started
            problem = difference(got, sql_rows(con, q.sql)) if q.sql else None
            note = f"{len(got[1])} rows" + ("" if q.sql else " (no sql)") + (" EMPTY" if not got[1] else "")
        except Exception as error:  # report and go on with the next query
            seconds, note, problem = time.time() - started, "", f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32} {seconds:6.2f}s {note} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
