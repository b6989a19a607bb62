"""Every registered query of the library's own operators against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from panelspark.plans import catalog

SF = "/root/testdata/sf0.001"
#: Covered by other queries and tests: the models' facts below, grids and logs in test_operators.
SLOW = {"experiment_grid", "run_table", "leaderboard", "gbt_scores", "boosted_early_stop", "rf_scores", "mlp_scores"}


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        yield c


def _plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert _plain(got.collect()) == _plain(duck.execute(f"select {columns} from ({catalog.oracle_sql()[name]})").fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert rows
    for r in rows:
        if "p1" in r.__fields__:
            assert 0 <= r["p1"] <= 1
    spark.catalog.clearCache()
