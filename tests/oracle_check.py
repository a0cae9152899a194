"""Compare registered queries with their oracles: python tests/oracle_check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if v is None:
        return "~null"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    left = sorted(tuple(norm(r[c]) for c in cols) for r in spark_df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    idx = [names.index(c) for c in cols] if sorted(names) == cols else None
    if idx is None:
        return f"columns differ: spark {cols} sql {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    right = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    odd = {c: t for c, t in types.items() if "HUGE" in t or "DECIMAL" in t}
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}: {left[:2]} {right[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ: {cols} {bad[:2]}"
    return f"ok {len(left)} rows" + (f" TYPES {odd}" if odd else "")


def main(argv):
    from segmetrica.session import local_session
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(__import__("os").environ.get("CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    names = argv[1:] or list(entry.queries())
    oracles = entry.oracle_sql()
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            if name in oracles:
                msg = compare(df, con, oracles[name])
            else:
                msg = f"ok rows-only {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e)[:600]
        failed += not msg.startswith("ok")
        print(f"\n{time.time() - t0:6.2f}s {name}: {msg}", flush=True)
    print("FAILED", failed, "of", len(names))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
