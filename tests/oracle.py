"""Compare a registered query with its SQL, as the driver does: columns by name, rows in any order."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return int(v) if hasattr(v, "__int__") and not isinstance(v, (str, bytes)) else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)), key=repr)
