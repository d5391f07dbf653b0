"""Every archive query against DuckDB."""

import pytest

from cardloom.plans import cards, catalog, extraction, linkers, linking, mail, nearness, persons, searching, upkeep  # noqa: F401
from compare import SF, connect, rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_duckdb(spark, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(connect().execute(catalog.ORACLE[name]).df())


def test_band_gap_falls_into_the_last_band(spark):
    from pyspark.sql import functions as F

    from cardloom.operators.linkers import score_band

    assert spark.range(1).select(score_band(F.lit(0.245)).alias("b")).first().b == "0.92-1.00"
