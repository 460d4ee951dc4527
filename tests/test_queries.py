import os
from functools import lru_cache

import duckdb
import pandas as pd
import pytest

from ledgerline.plans import catalog, match_queries, sync_queries

DIR = os.environ.get("LEDGERLINE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in [*TABLES.split(), "documents"]:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def share():
    """What many queries begin with is computed once here; the queries themselves share nothing."""
    with pytest.MonkeyPatch.context() as patch:
        for module, name in ((match_queries, "_classified"), (match_queries, "_matches"), (sync_queries, "_albums"), (sync_queries, "_playlist_sync")):
            patch.setattr(module, name, lru_cache(getattr(module, name)))
        yield


def canon(df):
    def show(x):
        return "null" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(show, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_gives_what_sql_gives(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    assert canon(got) == canon(duck.execute(catalog.oracle_sql()[name]).df())


def test_names():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
