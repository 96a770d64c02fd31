"""Compare a Spark result with its SQL twin: names, types and the multiset of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def differences(df, con, statement: str) -> list[str]:
    problems = []
    spark_types = dict(df.dtypes)
    relation = con.sql(statement)
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    expected = {c: TYPE_NAMES.get(t, t) for c, t in spark_types.items()}
    if expected != duck_types:
        wrong = {c: (spark_types.get(c), duck_types.get(c))
                 for c in {*expected, *duck_types} if expected.get(c) != duck_types.get(c)}
        problems.append(f"schema {wrong}")
    names = sorted(spark_types)
    if names != sorted(duck_types):
        return problems
    left = Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())
    order = [relation.columns.index(c) for c in names]
    right = Counter(tuple(_cell(r[i]) for i in order) for r in relation.fetchall())
    if left != right:
        problems.append(f"rows {sum(left.values())} vs {sum(right.values())}; "
                        f"only spark {list((left - right).items())[:3]}; "
                        f"only sql {list((right - left).items())[:3]}")
    return problems
