"""Run catalogue queries in Spark and their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    return repr(value)


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    types = [str(table.schema.field(n).type) for n in names]
    return names, types, sorted(tuple(map(_plain, row)) for row in zip(*columns))


def compare(df, con, sql: str) -> tuple[bool, str]:
    names, types, left = _rows(df.toArrow())
    arrow = con.sql(sql).to_arrow_table()
    onames, otypes, right = _rows(arrow)
    if names != onames:
        return False, f"columns {names} != {onames}"
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}"
    if left != right:
        ours, theirs = set(left), set(right)
        only_left = [r for r in left if r not in theirs][:2]
        only_right = [r for r in right if r not in ours][:2]
        bad = sum(a != b for a, b in zip(left, right))
        return False, f"{bad} rows differ {names}\n   spark {only_left}\n   sql   {only_right}"
    note = [f"{n}:{a}/{b}" for n, a, b in zip(names, types, otypes) if a != b and "string" not in a]
    return True, f"{len(left)} rows" + (f" TYPES {note}" if note else "")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = argv[0]
    spark = make_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    names = [n for n in queries if any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)]
    con, failed = connect(sf), []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"{df.count()} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
