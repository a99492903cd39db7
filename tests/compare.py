"""Running a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


KINDS = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
}


def difference(frame, db, sql: str) -> str | None:
    """What differs between a Spark frame and a statement, or None."""
    relation = db.sql(sql)
    theirs_types = dict(zip(relation.columns, map(str, relation.types)))
    ours_types = {n: KINDS.get(t, t) for n, t in frame.dtypes}
    if set(theirs_types) != set(ours_types):
        return f"columns {sorted(ours_types)} / {sorted(theirs_types)}"
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = rows_of(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(bad)} rows differ, first {bad[0]}"
    if ours_types != theirs_types:
        return "types " + str({n: (ours_types[n], theirs_types[n]) for n in ours_types if ours_types[n] != theirs_types[n]})
    return None
