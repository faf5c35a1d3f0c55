"""Compare queries with their DuckDB twins: ``python tools/check.py [name-prefix …]``.

Environment: SF_DIR (default sf0.01).
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def compare(spark, con, name, query, sf_dir):
    """None if equal, else what differs."""
    from corpusloom.workload.registry import runner

    df = runner(query)(spark, sf_dir)
    got = table(df.columns, df.collect())
    if query.sql is None:
        return None
    res = con.execute(query.sql)
    want = table([c[0] for c in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        only = set(map(repr, got[1])) ^ set(map(repr, want[1]))
        return f"{len(got[1])} rows != {len(want[1])}; e.g. {sorted(only)[:4]}"
    for a, b in zip(got[1], want[1]):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6))
            for x, y in zip(a, b)
        ):
            bad = sum(x != y for x, y in zip(got[1], want[1]))
            return f"{bad} rows differ: {str(a)[:300]} != {str(b)[:300]}"
    kinds = [
        (c, type(x).__name__, type(y).__name__)
        for c, x, y in zip(got[0], *(rows[0] for rows in (got[1], want[1])))
        if type(x) is not type(y) and x is not None and y is not None
    ] if got[1] else []
    return f"types differ: {kinds}" if kinds else None


def main() -> int:
    from corpusloom.session import local_session
    from corpusloom.workload.registry import load

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries = load()
    wanted = sys.argv[1:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    spark, con, bad = local_session(8), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            verdict = compare(spark, con, name, queries[name], sf_dir)
        except Exception as e:
            verdict = f"{type(e).__name__}: {str(e)[:700]}"
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {time.time() - start:6.2f}s {name}  {verdict or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
