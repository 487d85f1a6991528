"""Run registered queries against their SQL: ``python tools/check.py SF_DIR [name prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return repr(v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def main(sf_dir: str, prefixes: list[str]) -> int:
    import duckdb
    from pyspark.sql import SparkSession

    from whence.plans import registry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, q in registry().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS  {name} rows={len(got)} spark={t1 - t0:.2f}s", flush=True)
                continue
            cur = con.execute(q.sql)
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            want = cur.fetchall()
            t2 = time.time()
            if sorted(names) != sorted(df.columns):
                raise ValueError(f"columns {sorted(df.columns)} != {sorted(names)}")
            a, b = _rows(got, df.columns), _rows(want, names)
            ok = a == b
            note = "" if got else "  EMPTY"
            types = dict(df.dtypes)
            same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}
            odd = [c for c in types if same.get(types[c]) != kinds[c] and not (types[c] == "string" and kinds[c] == "STRING")]
            if odd:
                note += "  TYPES " + ", ".join(f"{c}:{types[c]}/{kinds[c]}" for c in odd)
            print(f"{'OK   ' if ok else 'DIFF '} {name} rows={len(a)}/{len(b)} spark={t1 - t0:.2f}s sql={t2 - t1:.2f}s{note}", flush=True)
            if not ok:
                bad += 1
                print("   spark only:", [x for x in a if x not in set(b)][:2])
                print("   sql only:  ", [x for x in b if x not in set(a)][:2])
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
