"""Holds a query against DuckDB on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(names)
    return sorted(repr(tuple(row[n] for n in order)) for row in rows)


def same(df, con, sql):
    table = df.toArrow()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(table.column_names) == sorted(names)
    assert rows_of(names, table.to_pylist()) == rows_of(names, expected)
