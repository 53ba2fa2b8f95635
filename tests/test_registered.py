"""Every registered query of the table against its SQL, on made-up tables and on empty ones."""

import math
import random

import duckdb
import pytest

from keyfold.queries import QUERIES, SQL

KINDS = ["click", "error", "view", "buy"]
SCHEMAS = {
    "events": "event_id long, user_id long, event_type string, value double",
    "orders": "o_orderkey long, o_orderstatus string, o_orderpriority string",
    "customer": "c_custkey long, c_name string",
}


def made_up():
    r = random.Random(8)
    # keys repeat, a few have deletes last, and some are not there at all
    events = [(k, r.randrange(12), r.choice(KINDS), r.randrange(1, 90_000) / 4) for k in range(1_500)]
    orders = [(k * 3, r.choice("OFP"), f"{k % 5}-LEVEL") for k in range(200)]
    return {"events": events, "orders": orders, "customer": [(k, f"name {k}") for k in range(30, 60)]}


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    rows = made_up() if request.param == "rows" else dict.fromkeys(SCHEMAS, [])
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).coalesce(1).write.parquet(str(path / f"{name}.parquet"))
    return path


def plain(x):
    if isinstance(x, bytearray):
        return bytes(x)
    return "nan" if isinstance(x, float) and math.isnan(x) else x


def told(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_a_query_returns_what_its_sql_returns(spark, folder, name):
    own = QUERIES[name](spark, str(folder))
    with duckdb.connect() as db:
        for table in SCHEMAS:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder / table}.parquet/*.parquet')")
        want = db.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(own.columns) == sorted(columns)
        assert told(own.select(*columns).collect()) == told(want.fetchall())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
