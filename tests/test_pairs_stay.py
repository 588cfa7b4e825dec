"""Rows of place x product are not moved to be added up per place, and none of them is stored."""

import re

import pytest
from pyspark.sql import functions as F

from geodemand.plans import levels as LV
from geodemand.plans import market as M
from geodemand.plans import scoring as SC
from geodemand.session import shared_dir
from geodemand.sources import roles


@pytest.mark.parametrize("rows", [SC.scores, M.contests, roles.fact])
def test_sums_per_place_need_no_shuffle(spark, sf, rows):
    plan = rows(spark, sf).groupBy("place_id").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(place_id[^)]*\), ENSURE_REQUIREMENTS", plan)


def test_pairs_are_not_stored(spark, sf):
    before = SC.scores(spark, sf).count()
    assert before == M.contests(spark, sf).count() == SC.state(spark, sf).count()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    assert not [f for f in files if re.match(r"(scores|contests)-", f.getPath().getName())]


def test_items_above_places_are_those_of_the_whole_table(spark, sf):
    whole, above = LV.items(spark, sf).where("level != 'place'"), LV.items_above(spark, sf)
    columns = ["level", "id", "sku_id", "n_rows", "units"]
    assert above.count() == whole.count() > 0
    assert above.select(columns).exceptAll(whole.select(columns)).isEmpty()
