"""A Spark result against DuckDB's, as sorted values by column name."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(sql).df()


def plain(v):
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, int) or hasattr(v, "dtype") and v.dtype.kind in "iu":
        return repr(float(v))
    if isinstance(v, float):
        return repr(float(v) + 0.0)
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in pdf[names].itertuples(index=False))


def same(df, sql: str, sf_dir: str) -> None:
    names, got = rows(df.toPandas())
    wanted_names, wanted = rows(duck(sql, sf_dir))
    assert names == wanted_names
    assert len(got) == len(wanted)
    wrong = [(g, w) for g, w in zip(got, wanted, strict=True) if g != w]
    assert not wrong, (len(wrong), names, wrong[:3])
