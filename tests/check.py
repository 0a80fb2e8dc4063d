"""Runs registered queries next to their SQL in DuckDB and reports the differences."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(
        (tuple(_plain(v) for v in row) for row in pdf.itertuples(index=False, name=None)), key=str
    )


def _plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        v = v.tolist() if hasattr(v, "tolist") else v
        if isinstance(v, (list, tuple)):
            return tuple(_plain(x) for x in v)
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    return v if isinstance(v, str) else str(v)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)}/{len(a)} rows differ, e.g. {bad[0]}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from volumetry.session import local_session

    folder = "/root/testdata/" + sys.argv[1]
    names = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    runs, sqls = queries(), oracle_sql()
    failed = []
    for name in names or runs:
        t0 = time.time()
        try:
            df = runs[name](spark, folder)
            got = df.toPandas()
            t1 = time.time()
            if name not in sqls:
                print(f"rows {name:28s} {len(got):8d} {t1-t0:6.2f}s", flush=True)
                continue
            want = con.execute(sqls[name]).df()
            note = compare(got, want)
            kinds = [(f.name, f.dataType.simpleString(), str(want[f.name].dtype)) for f in df.schema
                     if f.name in want and not _same_kind(f.dataType.simpleString(), str(want[f.name].dtype))]
        except Exception as e:  # noqa: BLE001
            note, t1, kinds, got = f"{type(e).__name__}: {str(e)[:600]}", time.time(), [], []
        print(f"{'FAIL' if note else 'ok  '} {name:28s} {len(got):8d} {t1-t0:6.2f}s {note} {kinds or ''}", flush=True)
        if note:
            failed.append(name)
    print("failed:", failed)


def _same_kind(spark_type: str, pandas_type: str) -> bool:
    pairs = {"bigint": "int64", "int": "int32", "double": "float64", "float": "float32",
             "boolean": "bool", "string": ("object", "str")}
    want = pairs.get(spark_type)
    return want is None or pandas_type in (want if isinstance(want, tuple) else (want,))


if __name__ == "__main__":
    main()
