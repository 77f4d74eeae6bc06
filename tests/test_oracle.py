"""Every query of the library against its hand-written SQL, at sf0.01."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from hackney.oracle import ORACLE
from hackney.queries import QUERIES

SF_DIR = os.environ.get("HACKNEY_TEST_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(
    not os.path.isdir(SF_DIR), reason="the driver's tables are not here"
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        view = name.removesuffix(".parquet")
        connection.execute(
            f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')"
        )
    yield connection
    connection.close()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame:
        if frame[name].dtype == object or str(frame[name].dtype) in ("string", "str"):
            frame[name] = frame[name].map(lambda v: None if pd.isna(v) else str(v))
        elif "datetime" in str(frame[name].dtype):
            frame[name] = frame[name].astype("datetime64[us]").astype(object)
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    ours = canonical(contract.queries()[name](spark, SF_DIR).toPandas())
    theirs = canonical(duck.sql(contract.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs) > 0
    pd.testing.assert_frame_equal(
        ours, theirs, check_dtype=False, rtol=0, atol=1e-9, check_column_type=False
    )


def test_ids_repeat_among_valid_and_invalid_rows(spark):
    from hackney.adapters import trip_texts

    ids = trip_texts(spark, SF_DIR).selectExpr("trim(id) AS id").where("id <> ''")
    assert ids.distinct().count() < 0.85 * ids.count()
    valid = QUERIES["silver_validate"](spark, SF_DIR).where("is_valid").count()
    assert QUERIES["silver_build"](spark, SF_DIR).count() < valid
