"""The driver contract, and every query with its SQL twin on the smallest data."""
import sys
from pathlib import Path

import pytest
from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as contract
from postloom import lookups
from postloom.plans.catalog import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import database, differences  # noqa: E402


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "ats_score" in df.columns


def test_twins_cover_all_but_the_nested_result():
    assert set(QUERIES) - set(contract.oracle_sql()) == {"assemble_analysis"}
    assert set(QUERIES) <= set(contract.queries())


def test_stop_words_are_sparks(spark):
    theirs = [w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w]
    assert set(lookups.STOP_WORDS) == set(theirs)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    ours = contract.queries()[name](spark, sf).toPandas()
    theirs = database(sf).execute(contract.oracle_sql()[name]).df()
    assert differences(ours, theirs) is None
    assert len(ours) > 0
