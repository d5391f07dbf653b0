"""Whole texts of cards don't go through the steps that choose a query's candidates."""

from cardloom.operators import search
from cardloom.plans import searching
from compare import SF


def test_bodies_stay_out_of_candidates(spark):
    flagged = searching._flagged(spark, SF)
    ranks = spark.createDataFrame([("card-document-7", 0.1)], "uid string, rank double")
    held = search.lexical_candidates(flagged, ranks, 20)
    assert "body" not in flagged.columns and "body" not in held.columns
