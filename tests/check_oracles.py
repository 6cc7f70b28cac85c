"""Compare registered queries with their SQL on DuckDB: python tests/check_oracles.py <sf> [name-prefix ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, float):
        return (2, round(v, 6) + 0.0)
    if isinstance(v, int):
        return (2, float(v))
    return (3, str(v))


def compare(df, con, sql):
    """Empty string when columns, types and rows agree."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} <> {sorted(rel.columns)}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema.fields:
        want = kinds.get(f.dataType.simpleString())
        if want != theirs[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} <> {theirs[f.name]}"
    mine = sorted(tuple(_key(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    other = sorted(tuple(_key(v) for v in row) for row in rel.project(quoted).fetchall())
    if len(mine) != len(other):
        return f"rows {len(mine)} <> {len(other)}"
    for a, b in zip(mine, other):
        for x, y in zip(a, b):
            same = x == y or (x[0] == y[0] == 2 and math.isclose(x[1], y[1], abs_tol=1.1e-6 if "--loose" in sys.argv else 0))
            if not same:
                return f"row {a} <> {b}"
    return ""


if __name__ == "__main__":
    from tidegrid.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", shuffle_partitions=4)
    con = connect(folder)
    sql = entry.oracle_sql()
    wanted = [a for a in sys.argv[2:] if not a.startswith("--")]
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                verdict = compare(df, con, sql[name])
            else:
                verdict, n = "", df.count()
                name += f" (rows only: {n})"
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(verdict)
        print(f"{'BAD ' if verdict else 'ok  '}{time.time() - start:6.1f}s {name} {verdict}", flush=True)
    print("failed:", bad)
