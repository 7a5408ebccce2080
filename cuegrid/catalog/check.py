"""Run registered queries and compare them with their SQL in DuckDB.

    python -m cuegrid.catalog.check /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

from cuegrid.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def compare(spark_rows, spark_names, duck_rows, duck_names) -> str:
    """Empty when equal, else what differs."""
    if sorted(spark_names) != sorted(duck_names):
        return f"columns {sorted(spark_names)} vs {sorted(duck_names)}"
    order = sorted(spark_names)
    a = [tuple(_plain(r[spark_names.index(n)]) for n in order) for r in spark_rows]
    b = [tuple(_plain(r[duck_names.index(n)]) for n in order) for r in duck_rows]
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    key = lambda row: tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "",
                             v if v is not None else 0) for v in row)
    a.sort(key=key)
    b.sort(key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ {order}: {str(bad[0])[:600]}" if bad else ""


def main(argv: list[str]) -> int:
    from cuegrid.catalog import load

    queries, oracles = load()
    folder, wanted = argv[0], argv[1:]
    spark, con = local_session(), connect(folder)
    failed = 0
    for name, make in queries.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            out = make(spark, folder)
            rows, names = [tuple(r) for r in out.collect()], out.columns
            took = time.time() - begin
            if name in oracles:
                cur = con.execute(oracles[name])
                problem = compare(rows, names, cur.fetchall(), [d[0] for d in cur.description])
            else:
                problem = ""
        except Exception as exc:  # noqa: BLE001 - report and go on
            took, rows, problem = time.time() - begin, [], f"{type(exc).__name__}: {str(exc)[:900]}"
        kind = "sql" if name in oracles else "rows only"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {len(rows)} rows {took:.1f}s "
              f"{problem}", flush=True)
        failed += bool(problem)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
