"""Compare every query with its SQL on one data folder: python tests/compare.py DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return "NaN" if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(names, cursor.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if got != want:
        left, right = set(map(repr, got)), set(map(repr, want))
        return (f"rows {len(got)} / {len(want)}; only Spark {[x[:300] for x in sorted(left - right)[:2]]}; "
                f"only SQL {[x[:300] for x in sorted(right - left)[:2]]}")
    kinds = dict(spark_df.dtypes)
    sql_kinds = {d[0]: str(d[1]) for d in cursor.description}
    alike = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    odd = {n: (kinds[n], sql_kinds[n]) for n in names if alike.get(kinds[n], "").upper() != sql_kinds[n].upper()}
    return f"types {odd}" if odd and "-t" in sys.argv else None


def main() -> None:
    import __spark_entry__ as e
    from tests.conftest import session
    spark = session()
    sf_dir, names = sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("-")]
    con, oracles = duck(sf_dir), e.oracle_sql()
    for name, job in e.queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            if name in oracles:
                result = difference(job(spark, sf_dir), con, oracles[name]) or "ok"
            else:
                result = f"no SQL, {job(spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001
            result = f"FAILED {type(error).__name__} {str(error)[:600]}"
        print(f"{name:26s} {time.time() - begin:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main()
