"""Registered queries against their SQL at the smallest scale; results are never vacuous by accident."""

import duckdb
import pytest

from changelens.plans import blocks, catalog, evidence, rules, stored, streams  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"q_chunk_ids_unique", "q_secret_scan"}  # violations, and secrets that the smallest scale lacks


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return c


def normal(df, columns):
    def one(v):
        if v is None or v != v:
            return "null"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


def numbers(rows):
    return [tuple(f"{float(v):.6f}" if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v for v in r) for r in rows]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(numbers(normal(got, columns))) == sorted(numbers(normal(want, columns)))
    assert len(got) or name in EMPTY


def test_state_match_has_each_class(spark):
    kinds = {r.status for r in catalog.q_state_match(spark, "/root/testdata/sf0.01").select("status").distinct().collect()}
    assert kinds == {"unchanged", "modified", "current_only", "previous_only"}


def test_change_is_tri_state(spark):
    assert {r.changed for r in catalog.q_change_summary(spark, "/root/testdata/sf0.01").collect()} == {None, True, False}
