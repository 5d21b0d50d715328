"""Run registered questions next to their SQL.  python tests/compare.py [sf] [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "None"
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, folder, name, query, sql):
    """(same, message)"""
    started = time.time()
    df = query(spark, folder)
    got, names = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    started = time.time()
    result = con.execute(sql)
    want, want_names = rows_of([d[0] for d in result.description], result.fetchall())
    sql_took = time.time() - started
    if names != want_names:
        return False, f"columns {names} / {want_names}"
    types = dict(df.dtypes)
    kinds = {d[0]: str(d[1]) for d in result.description}
    shapes = {"bigint": ("BIGINT", "NUMBER"), "string": ("VARCHAR", "STRING"), "double": ("DOUBLE", "NUMBER"),
              "boolean": ("BOOLEAN", "bool"), "int": ("INTEGER", "NUMBER")}
    odd = [f"{c}: {types[c]} / {kinds[c]}" for c in names if kinds[c] not in shapes.get(types[c], (kinds[c],))]
    note = f"{len(got)} rows, {took:.1f} s, sql {sql_took:.1f} s" + (f", types {odd}" if odd else "")
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return False, f"{note}; sql has {len(want)}; only here {extra}; only sql {missing}"
    return True, note


def main():
    from casetrail.plans import ORACLE, QUERIES
    from casetrail.session import build

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark = build("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                            "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            same, note = compare(spark, con, folder, name, QUERIES[name], ORACLE.get(name))
        except Exception as exc:  # noqa: BLE001
            same, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not same
        print(f"{'ok  ' if same else 'FAIL'} {name}: {note[:1500]}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
