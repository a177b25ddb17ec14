"""Run registered queries and their SQL, and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    import decimal

    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def compare(rows_a, cols_a, rows_b, cols_b):
    if sorted(cols_a) != sorted(cols_b):
        return f"columns {sorted(cols_a)} vs {sorted(cols_b)}"
    oa = sorted(range(len(cols_a)), key=lambda i: cols_a[i])
    ob = sorted(range(len(cols_b)), key=lambda i: cols_b[i])
    key = lambda r: tuple((x is not None, str(type(x)) if isinstance(x, (str, tuple)) else "", x if x is not None else 0) for x in r)
    a = sorted((tuple(norm(r[i]) for i in oa) for r in rows_a), key=lambda r: str(r))
    b = sorted((tuple(norm(r[i]) for i in ob) for r in rows_b), key=lambda r: str(r))
    if len(a) != len(b):
        extra = [r for r in a if r not in set(b)][:3] if len(a) < 5000 else []
        lost = [r for r in b if r not in set(a)][:3] if len(a) < 5000 else []
        return f"row count {len(a)} vs {len(b)}; only spark {extra}; only sql {lost}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {[cols_a[i] for i in oa]}: {bad[0][0]} vs {bad[0][1]}"
    return None


def family(kind: str) -> str:
    """Coarse type of a column, the same names for both engines."""
    k = kind.lower()
    if any(t in k for t in ("array", "list", "[]", "struct", "map")):
        return "nested"
    for names, fam in (
        (("tinyint", "smallint", "bigint", "int", "integer", "long", "short", "byte"), "int"),
        (("double", "float", "real"), "float"), (("varchar", "string"), "string"), (("boolean", "bool"), "bool"), (("timestamp", "timestamp_ntz", "date"), "time"),
    ):
        if k in names:
            return fam
    return k


def check(spark, con, name, fn, sql, sf_dir):
    """Return (seconds, rows, problem or None)."""
    t = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    sec = time.time() - t
    if sql is None:
        return sec, len(rows), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    problem = compare([tuple(r) for r in rows], df.columns, cur.fetchall(), cols)
    if problem is None:
        ours = {c: family(t) for c, t in df.dtypes}
        theirs = {d[0]: family(str(d[1])) for d in cur.description}
        odd = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
        problem = f"types differ: {odd}" if odd else None
    return sec, len(rows), problem


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    picks = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            sec, n, problem = check(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            sec, n, problem = 0.0, -1, f"{type(e).__name__}: {str(e)[:700]}"
        state = "FAIL" if problem else ("ok" if name in sqls else "rows")
        bad += bool(problem)
        print(f"{state:5s} {name:40s} {sec:6.2f}s {n:7d} rows {problem or ''}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(sys.argv[1:])
