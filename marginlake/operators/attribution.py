"""Attribution over orders: resolved channels against what platforms claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlake.functions.attribution import CHANNELS, platform_claims, resolve_attribution
from marginlake.functions.money import money_sum, ratio_or_zero, zero_if_null


def attribute_orders(
    orders: DataFrame,
    *,
    url: str = "landing_url",
    source: str = "utm_source",
    tags: str = "order_tags",
    strict: bool = False,
    preserve_case: bool = False,
) -> DataFrame:
    """Add channel, attribution_tier, confidence_score and click_id to each order."""
    verdict = resolve_attribution(
        F.col(url), F.col(source), F.col(tags), strict=strict, preserve_case=preserve_case
    )
    return orders.withColumn("_verdict", verdict).select(*orders.columns, "_verdict.*")


def claimed_vs_resolved(
    orders: DataFrame,
    ads: DataFrame,
    *,
    by: Sequence[str] = (),
    url: str = "landing_url",
    source: str = "utm_source",
    tags: str = "order_tags",
) -> DataFrame:
    """Revenue each platform would claim, revenue it earned, and both ROAS figures.

    The channels are few and fixed, so every order adds to conditional sums in one
    row, which is turned into one row per channel after the aggregation.
    """
    inputs = (F.col(url), F.col(source), F.col(tags))
    claims = platform_claims(*inputs)
    no = F.lit(False)
    flagged = orders.select(
        *by,
        F.col("gross_revenue").cast("decimal(12,2)").alias("revenue"),
        resolve_attribution(*inputs)["channel"].alias("winner"),
        *[claims.get(c, no).alias(f"claim{i}") for i, c in enumerate(CHANNELS)],
    )
    revenue = F.col("revenue")
    totals, rows = [], []
    for i, c in enumerate(CHANNELS):
        won, claimed = F.col("winner") == c, F.col(f"claim{i}")
        totals += [
            F.count_if(won).alias(f"won{i}"),
            F.count_if(won | claimed).alias(f"seen{i}"),
            zero_if_null(money_sum(F.when(claimed, revenue))).alias(f"claimed{i}"),
            zero_if_null(money_sum(F.when(won, revenue))).alias(f"earned{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(c).alias("channel"),
                F.col(f"seen{i}").alias("seen"),
                F.col(f"won{i}").alias("resolved_orders"),
                F.col(f"claimed{i}").alias("claimed_revenue"),
                F.col(f"earned{i}").alias("resolved_revenue"),
            )
        )
    sums = (
        flagged.groupBy(*by)
        .agg(*totals)
        .select(*by, F.inline(F.array(*rows)))
        .where(F.col("seen") > 0)
    )
    spent = ads.groupBy(*by, "channel").agg(money_sum("ad_spend").alias("spend"))
    spend = zero_if_null(F.col("spend"))
    return sums.join(spent, [*by, "channel"], "left").select(
        *by,
        "channel",
        "resolved_orders",
        "claimed_revenue",
        "resolved_revenue",
        spend.alias("ad_spend"),
        ratio_or_zero(F.col("claimed_revenue"), spend).alias("claimed_roas"),
        ratio_or_zero(F.col("resolved_revenue"), spend).alias("true_roas"),
    )
