"""Run queries beside their SQL: python tests/oracle.py SF_DIR [NAME...]"""

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else round(v, 6))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def compare(spark, con, name, query, sql, sf_dir):
    """'' or what differs."""
    df = query(spark, sf_dir)
    want = con.execute(sql)
    cols = [d[0] for d in want.description]
    if sorted(cols) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(cols)}"
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    a = sorted(([plain(r[c]) for c in sorted(cols)] for r in df.collect()), key=key)
    b = sorted(([plain(x) for _, x in sorted(zip(cols, r, strict=True))] for r in want.fetchall()), key=key)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]  # noqa: B905
        return f"{name}: {len(a)} and {len(b)} rows, first {bad}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from tessella.session import get_session

    spark = get_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con, qs, sqls = duck(sf), entry.queries(), entry.oracle_sql()
    for n in names or sqls:
        t = time.time()
        try:
            if n in sqls:
                said = compare(spark, con, n, qs[n], sqls[n], sf)
            else:
                said = f"{n}: {qs[n](spark, sf).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{n}: {type(e).__name__} {str(e)[:300]}"
        print(("ok " + n if not said else said)[:500], round(time.time() - t, 1), flush=True)
