"""Compare every registered query with its SQL: ``python -m checks.run [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import REGISTRY
from emberlattice.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(v))
    return (1, str(v))


def compare(spark, con, sf_dir: str, name: str):
    fn, sql = REGISTRY[name]
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - start
    if sql is None:
        return "rows-only", len(mine), took, ""
    start = time.time()
    rel = con.sql(sql)
    theirs_cols = sorted(rel.columns)
    if theirs_cols != cols:
        return "COLUMNS", len(mine), took, f"{cols} vs {theirs_cols}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    theirs = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    sql_took = time.time() - start
    want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN"}
    kinds = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if want.get(t) != types[c]]
    if len(mine) != len(theirs):
        return "ROWS", len(mine), took, f"{len(mine)} vs {len(theirs)}"
    a = sorted(tuple(map(_key, r)) for r in mine)
    b = sorted(tuple(map(_key, r)) for r in theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        show = "\n".join(f"     {[v[1] for v in x]}\n     {[v[1] for v in y]}" for x, y in bad[:3])
        return "VALUES", len(mine), took, f"{len(bad)} rows differ {cols}\n{show}"
    return ("TYPES" if kinds else "ok"), len(mine), took, " ".join(kinds) + f" (sql {sql_took:.1f}s)"


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in REGISTRY if not args or any(n.startswith(a) for a in args)]
    spark = build_session("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in names:
        try:
            status, n, took, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            status, n, took, note = "ERROR", -1, 0.0, str(e)[:900]
        failed += status not in ("ok", "rows-only")
        print(f"{status:9} {name:36} rows={n:<7} {took:5.1f}s {note}", flush=True)
    print(f"{len(names)} run, {failed} failed")


if __name__ == "__main__":
    main()
