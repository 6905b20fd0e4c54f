"""Side-by-side check of a Spark query against its DuckDB SQL twin.

Compares sorted column names, per-column type families, row counts and the
order-insensitive multiset of rows (floats rounded to 6 places). Used by the
tests and by ``python -m rulesift.plans.oracle_check`` during development.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return float(v)  # counts may be int in one engine and float in the other
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


_FAMILY = {
    "bigint": "int64", "BIGINT": "int64", "int": "int32", "INTEGER": "int32",
    "double": "float64", "DOUBLE": "float64", "float": "float32", "FLOAT": "float32",
    "string": "str", "VARCHAR": "str", "boolean": "bool", "BOOLEAN": "bool",
    "timestamp": "ts", "timestamp_ntz": "ts", "TIMESTAMP": "ts", "TIMESTAMP WITH TIME ZONE": "ts",
    "smallint": "int16", "SMALLINT": "int16", "date": "date", "DATE": "date",
}


def _spark_family(dt) -> str:
    s = dt.simpleString()
    if s.startswith("array<"):
        return "list<" + _spark_family(dt.elementType) + ">"
    if s.startswith("struct<"):
        return "struct"
    return _FAMILY.get(s, s)


def _duck_family(t: str) -> str:
    if t.endswith("[]"):
        return "list<" + _duck_family(t[:-2]) + ">"
    if t.startswith("STRUCT"):
        return "struct"
    return _FAMILY.get(t, t)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: _spark_family(f.dataType) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    con = duck(sf_dir)
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    d_types = {}
    try:
        d_types = dict(zip(d_cols, [str(t) for t in con.sql(sql).types]))
    except Exception:  # noqa: BLE001
        pass
    t2 = time.time()
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, why=f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}")
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    tmis = {c: (s_types.get(c), _duck_family(d_types[c])) for c in order
            if c in d_types and s_types.get(c) != _duck_family(d_types[c])}
    sm = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
    dm = Counter(tuple(_norm(r[i]) for i in di) for r in d_rows)
    if sm != dm:
        only_s = list((sm - dm).elements())[:3]
        only_d = list((dm - sm).elements())[:3]
        out.update(ok=False, why=f"values differ; spark-only {only_s} oracle-only {only_d}",
                   columns=order)
        return out
    out.update(ok=not tmis, why=f"type families differ: {tmis}" if tmis else "")
    return out


def main(argv: list[str]) -> int:
    from rulesift.plans import catalog
    from rulesift.session import local_session
    catalog.load_all()
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = argv or sorted(catalog.ORACLE)
    spark = local_session()
    bad = 0
    for n in names:
        if n not in catalog.ORACLE:
            print(f"{n}: no oracle")
            continue
        try:
            r = compare(spark, n, catalog.QUERIES[n], catalog.ORACLE[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + n, {k: v for k, v in r.items() if k not in ("name", "ok")},
              flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
