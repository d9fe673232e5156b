"""Compare registered queries with their DuckDB twins (as the driver does).

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: rows on both sides, schema and value match, seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from lodestar.plans import catalog, fixtures  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in fixtures.TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        return tuple(_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if isinstance(v, bool):
        return v
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for _, r in df[cols].iterrows()]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = catalog.QUERIES[name](spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sp), "spark_sec": round(t1 - t0, 2)}
    sql = catalog.ORACLE_SQL.get(name)
    if sql is None:
        res["oracle"] = "none"
        return res
    dd = con.execute(sql).df()
    res["duck_rows"] = len(dd)
    res["cols_match"] = sorted(sp.columns) == sorted(dd.columns)
    if not res["cols_match"]:
        res["detail"] = f"spark={sorted(sp.columns)} duck={sorted(dd.columns)}"
        res["match"] = False
        return res
    a, b = rows(sp), rows(dd)
    res["match"] = a == b
    if not res["match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res["detail"] = str(diff)[:800]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(catalog.QUERIES)
    from lodestar.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:600]}
        ok = r.get("match", r.get("oracle") == "none") and "error" not in r
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
