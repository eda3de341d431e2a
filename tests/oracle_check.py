"""Compare registered queries with their SQL twins: `python tests/oracle_check.py [sf_dir] [name ...]`."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


_KIND = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def difference(df, con, sql):
    """None if equal, else a text that says where."""
    want = con.sql(sql)
    want_types = dict(zip(want.columns, map(str, want.types)))
    got_types = {f.name: _KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if got_types != want_types:
        return f"types: {set(got_types.items()) ^ set(want_types.items())}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected = rows_of(want.columns, want.fetchall())
    if len(got) != len(expected):
        return f"rows: {len(got)} against {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(bad)} rows differ in columns {sorted(df.columns)}, first: {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from zonecast.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("oracle-check"), connect(sf)
    sqls, fns = entry.oracle_sql(), entry.queries()
    failed = 0
    for name in sys.argv[2:] or fns:
        start = time.time()
        try:
            text = difference(fns[name](spark, sf), con, sqls[name]) if name in sqls else f"no SQL, {fns[name](spark, sf).count()} rows"
        except Exception as e:
            text = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += text is not None and not text.startswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.2f}s  {text or 'ok'}", flush=True)
    print("failed:", failed)
