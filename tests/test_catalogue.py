"""Every query with SQL gives the rows that DuckDB gives; every other one gives rows."""

import pytest

from spanloom.plans import catalogue
from tests.conftest import SMALL
from tests.oracle import check

MAY_BE_EMPTY = {"interval_within", "gap_check", "set_difference", "widest_methods"}
#: Recipes tested here; all of them are compared with their SQL as queries.
RECIPES = {"recipe_v1", "recipe_v5", "recipe_v9", "recipe_v18", "recipe_v20", "recipe_val_utr5", "recipe_val_enhancer"}
NAMES = sorted(n for n in catalogue.QUERIES if not n.startswith("recipe_v") or n in RECIPES)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.ORACLE_SQL])
def test_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SMALL, least=0 if name in MAY_BE_EMPTY else 1)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalogue.ORACLE_SQL])
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count()
