"""Local Spark-vs-DuckDB comparison (the same check the driver runs).

Row count, column names, and an order-insensitive hash of the values with
columns sorted by name.  Used by the tests and by ``python -m
vigilspark.plans.compare``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time

import duckdb

from ..sources.tables import TABLES, table_path


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def fingerprint(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(keyed).encode()).hexdigest()
    return [cols[i] for i in order], len(rows), h, keyed


def compare(spark, con, name, qfn, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    sc, sn, sh, sk = fingerprint(scols, srows)
    dc, dn, dh, dk = fingerprint(dcols, drows)
    ok = sc == dc and sn == dn and sh == dh
    if verbose:
        print(f"{'OK ' if ok else 'BAD'} {name}: rows spark={sn} duck={dn} "
              f"spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
        if not ok:
            if sc != dc:
                print("   cols spark:", sc, "\n   cols duck: ", dc)
            else:
                a, b = set(sk), set(dk)
                for x in list(a - b)[:3]:
                    print("   spark only:", x[:600])
                for x in list(b - a)[:3]:
                    print("   duck only: ", x[:600])
    return ok


def main(argv):
    from ..session import get_session
    from . import registry, oracle
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    spark = get_session("local[8]", 8)
    con = duck_connect(sf_dir)
    qs, sqls = registry.queries(), oracle.oracle_sql()
    bad = []
    for n in (names or list(qs)):
        if n not in sqls:
            df = qs[n](spark, sf_dir)
            print(f"--- {n}: no oracle, rows={df.count()}", flush=True)
            continue
        try:
            if not compare(spark, con, n, qs[n], sqls[n], sf_dir):
                bad.append(n)
        except Exception as e:  # report and continue
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:800]}", flush=True)
            bad.append(n)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
