"""Holds a query against its SQL on the smallest tables."""

import glob
import os
import tempfile

import duckdb


def differences(spark, query, sql: str, sf_dir: str) -> tuple[int, int, int]:
    """Rows of the query, rows missing from it, rows it has too many."""
    out = f"{tempfile.mkdtemp(prefix='oracle-')}/q"
    query(spark, sf_dir).write.parquet(out)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    con.execute(f"CREATE TABLE want AS {sql}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    names = [sorted(r[0] for r in con.execute(f"DESCRIBE {t}").fetchall()) for t in ("want", "got")]
    assert names[0] == names[1]
    cols = ", ".join(f'"{c}"' for c in names[0])

    def one(q: str) -> int:
        return con.execute(q).fetchall()[0][0]

    return one("SELECT count(*) FROM got"), one(f"SELECT count(*) FROM (SELECT {cols} FROM want EXCEPT ALL SELECT {cols} FROM got)"), one(f"SELECT count(*) FROM (SELECT {cols} FROM got EXCEPT ALL SELECT {cols} FROM want)")
