"""The paths taken for hot keys give the same rows as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thousand rows, of which a third belong to key 0, and some have no key."""
    return spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        ((F.col("id") * 7919) % 2003).alias("o"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 17).alias("v"),
        F.col("id"),
    )


OUTPUTS = {"n": ("row_number",), "top": ("max", "v"), "prev": ("lag", "v")}


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_over_cuts(spark, skewed, keys):
    plain = scale.running(skewed, keys, ["o", "id"], OUTPUTS)
    cut = scale.running(skewed, keys, ["o", "id"], OUTPUTS, hot_rows=100)
    assert "_cut" in cut._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join(spark, skewed, how):
    right = spark.range(0, 30).select(F.col("id").alias("k"), F.concat(F.lit("r"), "id").alias("r"))
    plain = skewed.join(right, ["k"], how)
    spread = scale.spread_join(skewed, right, ["k"], how, hot_rows=50)
    assert "_salt" in spread._jdf.queryExecution().analyzed().toString()
    assert plain.columns == spread.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))


def test_spread_join_spreads_the_hot_key(spark, skewed):
    right = spark.range(0, 30).select(F.col("id").alias("k"))
    salted = scale.spread_join(skewed, right, ["k"], "inner", hot_rows=50)
    text = salted._jdf.queryExecution().analyzed().toString()
    assert "_salt" in text and salted.where("k = 0").count() == skewed.where("k = 0").count()


def test_spread_join_refuses_other_kinds(spark, skewed):
    with pytest.raises(ValueError):
        scale.spread_join(skewed, skewed, ["k"], "full")


def test_sized_by_skips_the_count(spark, skewed):
    right = spark.range(0, 30).select(F.col("id").alias("k"))
    cheap = (spark.range(3).select(F.col("id").alias("c")), ["c"], 1)
    plain = scale.spread_join(skewed, right, ["k"], "left", hot_rows=50, sized_by=cheap)
    assert "_salt" not in plain._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, q):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.normal(0, 500, 701)] + [("b", 4.0)] * 90 + [("c", None), ("c", 2.5), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r["p"] for r in scale.exact_percentile(df, ["k"], "v", q, "p").collect()}
    for k in "abc":
        values = [v for g, v in data if g == k and v is not None]
        assert got[k] == pytest.approx(float(np.quantile(values, q)), abs=1e-9)
    assert "d" not in got
