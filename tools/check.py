"""Compare registered queries with their SQL on one scale: python tools_check.py [sf] [name-prefix ...]."""
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from provenor.catalogue import ORACLES, QUERIES  # noqa: E402
from provenor.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None))


def main():
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = df.toArrow()
            secs = time.time() - t0
            if name not in ORACLES:
                print(f"rows {name} {got.num_rows} rows {secs:.1f}s", flush=True)
                continue
            exp = con.execute(ORACLES[name]).to_arrow_table()
            gt = {f.name: str(f.type) for f in got.schema}
            et = {f.name: str(f.type) for f in exp.schema}
            a, b = rows(pd.DataFrame(got.to_pylist(), columns=got.column_names, dtype=object)), rows(pd.DataFrame(exp.to_pylist(), columns=exp.column_names, dtype=object))
            ok = a == b
            types = "" if gt == et else " TYPES " + str({k: (gt.get(k), et.get(k)) for k in {*gt, *et} if gt.get(k) != et.get(k)})
            print(f"{'ok  ' if ok else 'FAIL'} {name} {got.num_rows}/{exp.num_rows} rows {secs:.1f}s{types}", flush=True)
            if not ok:
                bad += 1
                print("   cols", a[0], b[0])
                sa, sb = set(a[1]), set(b[1])
                print("   only spark", sorted(sa - sb)[:3], len(sa - sb))
                print("   only sql  ", sorted(sb - sa)[:3], len(sb - sa))
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {type(e).__name__}: {str(e)[:700]}", flush=True)
    print("bad:", bad)


main()
