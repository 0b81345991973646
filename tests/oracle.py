"""Spark result against DuckDB result, values compared as text after sorting."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def same(df, sql, sf_dir):
    a, b = df.toPandas(), connect(sf_dir).sql(sql).df()
    for f in df.schema:  # pandas makes floats of whole numbers beside nulls
        if f.dataType.typeName() in ("long", "integer"):
            a[f.name], b[f.name] = a[f.name].astype("Int64"), b[f.name].astype("Int64")
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head(3).to_string() + "\n" + b[(a != b).any(axis=1)].head(3).to_string()
