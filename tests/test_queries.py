"""Registered queries against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__
from ridgeline.plans.oracles import ORACLE_SQL
from ridgeline.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: round(float(v), 4) if type(v).__name__ in ("float", "Decimal") else v
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, DIR)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_llm():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(top, "ridgeline")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "ridgeline.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
