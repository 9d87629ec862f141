"""Run registered queries and their oracles side by side: ``python tests/oracle_check.py DIR [key ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE",
}


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con, times: list | None = None) -> str | None:
    """None when both sides agree, else what differs."""
    begin = time.time()
    got = [tuple(r) for r in df.collect()]
    if times is not None:
        times.append(time.time() - begin)
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = res.fetchall()
    want_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    for field in df.schema.fields:
        mine = TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if mine != want_types[field.name]:
            return f"type of {field.name}: {mine} != {want_types[field.name]}"
    a, b = _rows(df.columns, got), _rows(want_names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return (
            f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb, key=repr)[:3]}; "
            f"only oracle {sorted(sb - sa, key=repr)[:3]}"
        )
    return None


def main(folder: str, keys: list[str]) -> int:
    import __spark_entry__ as entry
    from inkspan.session import local_session

    spark = local_session(8)
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for key, query in entry.queries().items():
        if keys and key not in keys:
            continue
        t, times = time.time(), []
        try:
            df = query(spark, folder)
            if key in oracles:
                diff = compare(df, oracles[key], con, times)
            else:
                n, diff = len(df.collect()), None
            note = "oracle" if key in oracles else f"rows={n}"
        except Exception as error:  # report and go on with the next key
            diff, note = traceback.format_exc()[-1500:] if keys else str(error)[:400], "error"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {key:24s} {note:10s} {time.time() - t:6.2f}s (spark {sum(times):5.2f}s) {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
