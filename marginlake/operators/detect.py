"""Anomaly detection over finished daily rows, and the alerts they raise.

Windows run on day-grain rows (one per day, or per channel/SKU and day), never on
orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginlake.functions.money import dec, percent_or_null, ratio_or_null
from marginlake.functions.text import fixed
from marginlake.operators.marts import latest_rows
from marginlake.operators.staging import REFUNDED, active_days, orders_counted

# Surge threshold, quiet-day floor, trailing days, history needed.
CAC_SURGE = "1.20"
MIN_ORDERS = 5
TRAILING_DAYS = 7
MIN_HISTORY = 6

# Alert wording.
CRITICAL = "CRITICAL"
SURGE_ACTION = "Audit underperforming ad sets on Meta & TikTok. Trim budget by 20%."
LOSS_ACTION = "Immediate ad spend capping required to prevent working capital drain."


def _trailing(by: Sequence[str], order: str = "date", days: int = TRAILING_DAYS):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-days, -1)


def cac_surge(daily: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Every active day with its trailing CAC mean, change and surge flag.

    The mean is kept as (sum, rows) so that the 20 % test is exact in decimals.
    """
    w = _trailing(by)
    scored = active_days(daily).select(
        *by,
        "date",
        "total_orders",
        F.col("blended_cac").cast("decimal(18,2)").alias("blended_cac"),
        F.sum(F.col("blended_cac").cast("decimal(18,2)")).over(w).alias("_sum"),
        F.count("blended_cac").over(w).alias("prior_days"),
    )
    cac, total, n = F.col("blended_cac"), F.col("_sum"), F.col("prior_days")
    surged = (
        (n >= MIN_HISTORY)
        & (total > 0)
        & (cac * n > total * dec(CAC_SURGE, 3, 2))
        & (F.col("total_orders") > MIN_ORDERS)
    )
    return scored.select(
        *by,
        "date",
        "total_orders",
        "blended_cac",
        "prior_days",
        ratio_or_null(total, n).alias("trailing_cac"),
        percent_or_null(cac * n - total, total, scale=1).alias("cac_change_pct"),
        F.coalesce(surged, F.lit(False)).alias("is_surge"),
    )


def latest_day(df: DataFrame, *, by: Sequence[str] = (), at: str = "date") -> DataFrame:
    """The row with the highest ``at`` (overall, or per ``by`` group)."""
    return latest_rows(df, at, 1, by=by)


def cac_surge_alerts(surge: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Alert rows for the flagged days of ``surge``."""
    title = F.concat(
        F.lit("Blended CAC surged +"), fixed(F.col("cac_change_pct"), 1), F.lit("% yesterday")
    )
    return surge.where("is_surge").select(
        *by,
        "date",
        F.lit(CRITICAL).alias("severity"),
        title.alias("title"),
        F.lit(SURGE_ACTION).alias("action"),
    )


def loss_alerts(daily: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Alert rows for active days that lost money."""
    title = F.concat(
        F.lit("Negative Net Cash Margin on "), F.date_format("date", "yyyy-MM-dd")
    )
    return (
        active_days(daily)
        .where(F.col("net_profit") < 0)
        .select(
            *by,
            "date",
            F.lit(CRITICAL).alias("severity"),
            title.alias("title"),
            F.lit(LOSS_ACTION).alias("action"),
        )
    )


def scan_alerts(daily: DataFrame, *, by: Sequence[str] = (), lookback: int = 30) -> DataFrame:
    """Alerts of the latest active day: CAC surge and negative profit.

    Looks at the latest ``lookback`` active days only and, like the surge rule,
    wants seven of them before saying anything.
    """
    recent = (
        latest_rows(active_days(daily), "date", lookback, by=by)
        .withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        .where(F.col("_days") >= TRAILING_DAYS)
    )
    last = latest_day(recent, by=by)
    surge = cac_surge_alerts(latest_day(cac_surge(recent, by=by), by=by), by=by)
    return surge.unionByName(loss_alerts(last, by=by))


def z_score(
    df: DataFrame,
    value: str,
    *,
    by: Sequence[str] = (),
    order: str = "date",
    days: int = TRAILING_DAYS,
    threshold: float = 3.0,
) -> DataFrame:
    """Z-score of ``value`` against its ``days`` preceding rows.

    The sample variance comes from exact decimal sums, so the result does not
    depend on the order in which rows are added. NULL without full history or
    without variation.
    """
    w = _trailing(by, order, days)
    x = F.col(value).cast("decimal(16,2)")
    scored = (
        df.withColumn("_x", x)
        .withColumn("_n", F.count("_x").over(w))
        .withColumn("_s", F.sum("_x").over(w).cast("decimal(18,2)"))
        .withColumn("_q", F.sum(F.col("_x") * F.col("_x")).over(w).cast("decimal(36,4)"))
    )
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    spread = (n * q - s * s).cast("double")
    dn = n.cast("double")
    sd = F.sqrt(spread / F.nullif(dn * (dn - 1.0), F.lit(0.0)))
    z = F.when(
        (n >= days) & (spread > 0), (F.col("_x").cast("double") - s.cast("double") / dn) / sd
    )
    return (
        scored.withColumn("z_score", z)
        .withColumn("is_anomaly", F.coalesce(F.abs("z_score") >= threshold, F.lit(False)))
        .drop("_x", "_n", "_s", "_q")
    )


def roas_decay(pnl: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Channel days with spend whose ROAS is below break-even.

    Break-even ROAS is revenue over gross margin: below it, each ad dollar returns
    less margin than it cost. Without margin no ROAS breaks even: a day that spent
    and sold nothing is below it.
    """
    revenue, spend = F.col("attributed_revenue"), F.col("channel_ad_spend")
    margin = revenue - F.col("attributed_cogs") - F.col("attributed_shipping")
    even = F.when(margin > 0, ratio_or_null(revenue, margin, scale=4))
    return (
        pnl.where(spend > 0)
        .select(
            *by,
            "date",
            "channel",
            "channel_roas",
            even.alias("break_even_roas"),
            (margin < spend).alias("is_below_break_even"),
        )
    )


def daily_refund_rate(
    orders: DataFrame,
    *,
    by: Sequence[str] = (),
    refunded: str = REFUNDED,
    unique_ids: bool = False,
) -> DataFrame:
    """Refunded share of the orders placed per day, in percent."""
    sums = orders.groupBy(*by, F.col("order_date").alias("date")).agg(
        orders_counted(unique_ids).alias("placed"),
        F.count_if(F.col("status") == refunded).alias("refunded"),
    )
    return sums.withColumn(
        "refund_rate_pct", percent_or_null(F.col("refunded"), F.col("placed"))
    )


def daily_z_scores(
    daily: DataFrame, refunds: DataFrame | None = None, *, by: Sequence[str] = ()
) -> DataFrame:
    """Z-scores of CAC, ROAS, revenue (and refund rate) as (date, metric, value, z).

    The daily rows are computed once and unfolded; one window scores all metrics.
    """

    def unfold(df: DataFrame, *metrics: str) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("decimal(16,2)").alias("value")) for m in metrics]
        return df.select(*by, "date", F.inline(F.array(*cells)))

    values = unfold(active_days(daily), "blended_cac", "blended_roas", "total_revenue")
    if refunds is not None:
        values = values.unionByName(unfold(refunds, "refund_rate_pct"))
    keys = [*by, "metric"]
    return z_score(values, "value", by=keys).select(*by, "date", "metric", "value", "z_score", "is_anomaly")
