"""Run registered queries beside their SQL and report any difference.

    python check.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from mapwright.plans import catalog
from mapwright.plans.fixtures import BASE_TABLES
from mapwright.session import build_session

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def compare(df, con, sql):
    """List of differences; empty when the two results agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).upper() for d in cur.description}
    want = cur.fetchall()
    got = df.collect()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != kinds[name]:
            out.append(f"type of {name}: {kind} != {kinds[name]}")
    order = sorted(names)
    a = Counter(tuple(norm(r[c]) for c in order) for r in got)
    pos = [names.index(c) for c in order]
    b = Counter(tuple(norm(r[p]) for p in pos) for r in want)
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if a != b:
        out.append(f"values differ: {order} only spark {list((a - b).items())[:2]} only sql {list((b - a).items())[:2]}")
    if not want:
        out.append("no rows")
    return out


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark, con = build_session("check"), duck(sf)
    oracles, bad, n = catalog.oracle_sql(), 0, 0
    for name, fn in catalog.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        n += 1
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                problems = [] if rows else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        took = time.time() - start
        bad += bool(problems)
        if problems or took > 4:
            print(f"{'FAIL' if problems else 'ok'} {name} {took:.1f}s", *[p[:900] for p in problems], sep="\n    ", flush=True)
    print(f"{n} run, {bad} with differences")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
