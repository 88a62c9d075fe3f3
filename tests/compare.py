"""Run registered queries and compare them with their SQL on DuckDB."""

from __future__ import annotations

import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == int(value):
        return int(value)
    return str(value) if not isinstance(value, (int, float, str, bool)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def mismatch(spark, con, name: str, run, sql: str | None, sf_dir: str) -> str | None:
    """A description of the difference, or None. Without SQL only runs the query."""
    found = run(spark, sf_dir)
    mine = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if sql is None:
        return None if mine else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} vs {sorted(names)}"
    if mine == theirs:
        return None if mine else "no rows"
    here, there = set(mine), set(theirs)
    only_mine, only_theirs = [r for r in mine if r not in there][:2], [r for r in theirs if r not in here][:2]
    return f"{len(mine)} vs {len(theirs)} rows\n  spark: {only_mine}\n  sql:   {only_theirs}"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.session import session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con, bad = session(), duck(sf_dir), 0
    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            problem = mismatch(spark, con, name, run, sql.get(name), sf_dir)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        kind = "ok " if name in sql else "ran"
        print(f"{kind if problem is None else 'BAD'} {name} {time.time() - began:.1f}s" + (f" {problem[:1800]}" if problem else ""), flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
