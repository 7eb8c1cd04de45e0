"""Run registered queries next to their oracle SQL and compare all values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


#: Queries that SQL cannot repeat: file listings, a tagger hook, free samples whose keys and bounds other queries check, loess (see test_stl).
NO_SQL = {"ts_stl", "pii_entities", "source_files", "parameter_gate", "single_synth", "text_synth", "multi_synth", "hier_synth"}


def compare(spark, con, query, sql, sf_dir, name=None):
    """None when equal, else a short text."""
    df = query(spark, sf_dir)
    sc, sr = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        if name not in NO_SQL:
            return "no oracle"
        return None if sr else "no rows"
    cur = con.execute(sql)
    dc, dr = table([c[0] for c in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if sr == dr:
        return None
    only_s = [r for r in sr if r not in set(dr)][:3] if len(sr) < 500000 else []
    only_d = [r for r in dr if r not in set(sr)][:3] if len(dr) < 500000 else []
    return f"rows {len(sr)} vs {len(dr)}\n   spark {only_s}\n   sql   {only_d}"


def main(argv):
    from likeness.plans import registry
    from likeness.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, os_ = registry.queries(), registry.oracles()
    bad = 0
    for name, q in qs.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            msg = compare(spark, con, q, os_.get(name), sf_dir, name)
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += msg is not None
        kind = "" if name in os_ else " (rows only)"
        print(f"{'ok ' if msg is None else 'BAD'} {name}{kind} {time.time() - t:.1f}s{'' if msg is None else ' ' + msg}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
