"""Every named query against its SQL, and the plans of some."""

import pytest

import __spark_entry__ as app
import check
from adquanta.plans.campaign import OPERATIONS
from adquanta.session import stage
from adquanta.sources.tables import campaigns

SLOW = {"ml_metrics", "ml_importance", "ml_report"}  # the same training as ml_score


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(app.queries()) - SLOW))
def test_query(spark, con, sf_dir, name):
    n, diff = check.compare(spark, con, sf_dir, name)
    assert n > 0 and not diff


def test_entry_is_lazy_and_ranked(spark):
    rows = app.entry(spark).collect()
    assert [r.roas for r in rows] == sorted((r.roas for r in rows), reverse=True)


def test_sql_belongs_to_queries():
    assert set(app.oracle_sql()) <= set(app.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from adquanta.operators.segments import segment

    text = plan(segment(campaigns(spark, sf_dir), "target_age", "BUILDING").select("ad_id"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "l_extendedprice" not in text.split("Physical Plan")[1]


def test_quantile_cut_reaches_the_scan(spark, sf_dir):
    loaded = stage(campaigns(spark, sf_dir), "campaigns")
    text = plan(OPERATIONS["topk"](loaded)).split("Physical Plan")[1]
    assert "GreaterThan(roas" in text and "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<ad_id:bigint,revenue:double,roas:double>" in text


def test_no_cartesian_products(spark, sf_dir):
    loaded = stage(campaigns(spark, sf_dir), "campaigns")
    for operation in OPERATIONS.values():
        text = plan(operation(loaded))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_pivot_sums_equal_group_sums(spark, sf_dir):
    from pyspark.sql import functions as F

    df = campaigns(spark, sf_dir)
    wide = OPERATIONS["pivot"](df)
    rows = {r.advertiser: sum(r[c] for c in wide.columns if c != "advertiser") for r in wide.collect()}
    sums = df.groupBy("advertiser").agg(F.sum("revenue").alias("s"))   # rows without a platform too
    assert rows == pytest.approx({r.advertiser: r.s for r in sums.collect()})


def test_whole_pivot_keeps_all_revenue(spark):
    from adquanta.operators.kpis import pivot_sum

    rows = [("x", "A", 1.0), ("x", None, 2.0), ("x", "Z", 4.0), ("y", None, 8.0), (None, "A", 16.0), ("w", "A", 32.0)]
    df = spark.createDataFrame(rows, "advertiser string, platform string, revenue double")
    got = {tuple(r) for r in pivot_sum(df, "advertiser", "platform", ["A"], "revenue", other="rest").collect()}
    assert got == {("x", 1.0, 6.0), ("y", 0.0, 8.0), (None, 16.0, 0.0), ("w", 32.0, 0.0)}
    with pytest.raises(ValueError):
        pivot_sum(df, "advertiser", "platform", ["A"], "revenue", other="A")


def test_whole_pivot_adds_up_to_the_revenue(spark, sf_dir):
    from pyspark.sql import functions as F

    wide = app.queries()["pivot_revenue_whole"](spark, sf_dir)
    rows = {r.advertiser: sum(r[c] for c in wide.columns if c != "advertiser") for r in wide.collect()}
    sums = campaigns(spark, sf_dir).groupBy("advertiser").agg(F.sum("revenue").alias("s"))
    assert rows == pytest.approx({r.advertiser: r.s for r in sums.collect()})


def test_a_changed_table_is_fitted_anew(spark, sf_dir, tmp_path):
    """The model of a folder is kept while its files are, and no longer."""
    from adquanta.plans import model

    for name in model.CAMPAIGN_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    first = model._fitted(spark, folder)
    assert model._fitted(spark, folder)[0] is first[0]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    second = model._fitted(spark, folder)
    assert second[0] is not first[0]
    assert second[1].count() == orders.where("o_orderkey % 2 = 0").count() < first[1].count()
