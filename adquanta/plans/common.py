"""Helpers shared by the named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    """Two dictionaries and a decorator that files a query and its SQL in them."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(check: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if check is not None:
                sql[fn.__name__] = check
            return fn
        return add

    return queries, sql, query


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round doubles so that sums in another order compare equal."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def r(x: str, n: int) -> str:
    """SQL text: round half up on the printed decimal, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"


# The campaign table, one row per order, written independently of the adapter.
CAMPAIGNS = """
rollup AS (
  SELECT l_orderkey,
         string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS platform,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks,
         CAST(sum(CAST(l_quantity AS BIGINT) * (20 + l_linenumber)) AS BIGINT) AS impressions,
         CAST(count(*) AS INTEGER) AS conversions,
         CAST(date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS INTEGER)
           AS duration_days,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1000e0 AS spent,
         sum(CAST(round(l_extendedprice * (1 + l_tax) * 100) AS BIGINT)) / 1000e0 AS budget
  FROM lineitem GROUP BY l_orderkey
),
campaigns AS (
  SELECT o_orderkey AS ad_id, n_name AS advertiser, r_name AS country, o_orderdate AS start_date,
         platform, c_mktsegment AS target_age, o_orderstatus AS target_gender,
         duration_days, impressions, clicks,
         100e0 * clicks / nullif(impressions, 0) AS ctr_pct,
         conversions,
         100e0 * conversions / nullif(clicks, 0) AS cr_pct,
         spent, spent / nullif(clicks, 0) AS cpc, spent / nullif(conversions, 0) AS cac,
         o_totalprice AS revenue, o_totalprice / nullif(spent, 0) AS roas, budget
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN rollup ON o_orderkey = l_orderkey
)"""

FEATURES = CAMPAIGNS + f""",
feats AS (
  SELECT * REPLACE (coalesce(cac, 0) AS cac),
         CASE WHEN roas > 5 THEN 1 ELSE 0 END AS high_performer,
         {r('spent / nullif(budget, 0)', 4)} AS budget_utilization,
         {r('clicks / nullif(CAST(duration_days AS DOUBLE), 0)', 2)} AS clicks_per_day,
         {r('spent / nullif(impressions, 0)', 6)} AS spend_per_impression,
         coalesce({r('revenue / nullif(clicks, 0)', 2)}, 0) AS revenue_per_click,
         CASE WHEN platform LIKE '%,%' THEN 1 ELSE 0 END AS is_multi_platform,
         {r('ctr_pct * cr_pct', 6)} AS ctr_cr_product,
         coalesce({r('revenue / nullif(spent, 0)', 4)}, 0) AS cost_efficiency
  FROM campaigns
)"""

# The composite score with terciles.
SCORED = CAMPAIGNS + """,
ends AS (
  SELECT min(roas) AS r0, max(roas) AS r1, min(ctr_pct) AS t0, max(ctr_pct) AS t1,
         min(cr_pct) AS c0, max(cr_pct) AS c1 FROM campaigns
),
scored AS (
  SELECT c.*,
         (roas - r0) / (r1 - r0 + 1e-9) AS roas_norm,
         (ctr_pct - t0) / (t1 - t0 + 1e-9) AS ctr_pct_norm,
         (cr_pct - c0) / (c1 - c0 + 1e-9) AS cr_pct_norm
  FROM campaigns c, ends
),
composite AS (
  SELECT *, 0.45e0 * roas_norm + 0.30e0 * ctr_pct_norm + 0.25e0 * cr_pct_norm AS ml_score FROM scored
),
cuts AS (
  SELECT quantile_cont(ml_score, 0.33) AS q33, quantile_cont(ml_score, 0.66) AS q66 FROM composite
),
prioritised AS (
  SELECT c.*, CASE WHEN ml_score >= q66 THEN 'HIGH' WHEN ml_score >= q33 THEN 'MEDIUM' ELSE 'LOW' END
           AS priority
  FROM composite c, cuts
)"""

# The ad-event view over the events table.
AD_EVENTS = """
ad_events AS (
  SELECT event_id, ts, 'adv_' || (user_id % 10) AS advertiser, 'P' || (user_id % 3) AS platform,
         CASE event_type WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'conversion'
              WHEN 'error' THEN 'bounce' ELSE event_type END AS event_type,
         value AS cost,
         CASE WHEN event_type = 'purchase' THEN 20 * value ELSE 0 END AS revenue,
         'camp_' || json_extract_string(props, '$.k') AS campaign_id,
         CAST(user_id % 3 AS INTEGER) AS partition
  FROM events
)"""
