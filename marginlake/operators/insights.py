"""Plain-language insights, the morning briefing and the KPI scorecard, as rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlake.functions.text import currency_text, fixed, grouped, multiplier_text
from marginlake.operators import kpis
from marginlake.operators.customers import cohort_matrix_of_orders, latest_returning_cohort
from marginlake.operators.detect import latest_day
from marginlake.operators.staging import COMPLETED, completed_only

# The tones, and the sentences and limits of the insights and reports below.
POSITIVE, NEUTRAL, NEGATIVE = "positive", "neutral", "negative"


def _insight(position: int, by: Sequence[str], title: Column, body: Column, tone: Column) -> list:
    return [
        *by,
        F.lit(position).alias("position"),
        title.alias("title"),
        body.alias("body"),
        tone.alias("tone"),
    ]


def best_and_worst_channel(breakdown: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Highest and lowest ROAS channel; ties keep the report order."""
    row = F.struct("channel", "roas")
    pos = F.col("position")
    return breakdown.groupBy(*by).agg(
        F.max_by(row, F.struct(F.col("roas"), -pos)).alias("best"),
        F.min_by(row, F.struct(F.col("roas"), -pos)).alias("worst"),
    )


def _channel_said(top: Column, bottom: Column) -> tuple[Column, Column, Column]:
    best, worst, name = top["roas"], bottom["roas"], top["channel"]
    body = F.concat(
        name,
        F.lit(" is returning "),
        fixed(best / F.nullif(worst, F.lit(0.0)), 1),
        F.lit("× the ROAS of "),
        bottom["channel"],
        F.lit(" ("),
        multiplier_text(best),
        F.lit(" vs "),
        multiplier_text(worst),
        F.lit("). Shift budget there."),
    )
    return F.concat(name, F.lit(" is outperforming the rest")), body, F.lit(POSITIVE)


def _differ(top: Column, bottom: Column) -> Column:
    return (top["roas"] > 0) & (bottom["roas"] > 0) & (top["roas"] > bottom["roas"])


def channel_insight(breakdown: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Best against worst channel, when both earn and differ."""
    top, bottom = F.col("best"), F.col("worst")
    found = best_and_worst_channel(breakdown, by=by).where(_differ(top, bottom))
    return found.select(*_insight(1, by, *_channel_said(top, bottom)))


def _profit_said() -> tuple[Column, Column, Column]:
    gaining = F.col("month_profit") >= 0
    body = F.concat(
        F.lit("Profit in the last 7 days: "),
        currency_text(F.col("week_profit")),
        F.lit(" · this month: "),
        currency_text(F.col("month_profit")),
        F.lit("."),
    )
    title = F.when(gaining, "You're generating profit").otherwise("You're burning cash")
    return title, body, F.when(gaining, POSITIVE).otherwise(NEGATIVE)


def profit_insight(profit: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Profit of the last week and the month to date."""
    return profit.select(*_insight(2, by, *_profit_said()))


def repeat_insight(matrix: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """First-month repeat rate of the newest cohort that has one."""
    m1 = F.col("m1")
    body = F.concat(
        F.lit("Your "),
        F.col("label"),
        F.lit(" cohort is repurchasing at "),
        fixed(m1, 1),
        F.lit("% within 30 days. "),
        F.when(m1 >= 25, "Strong retention is driving CAC down.").otherwise(
            "Room to improve with win-back flows."
        ),
    )
    tone = F.when(m1 >= 25, POSITIVE).when(m1 >= 10, NEUTRAL).otherwise(NEGATIVE)
    return latest_returning_cohort(matrix, by=by).select(
        *_insight(3, by, F.lit("Repeat purchases"), body, tone)
    )


def _cac_said() -> tuple[Column, Column, Column]:
    delta = F.col("cac_delta")
    falling, rising = delta <= -1, delta >= 1
    title = (
        F.when(falling, "Acquisition cost is falling")
        .when(rising, "Acquisition cost is rising")
        .otherwise("Acquisition cost is stable")
    )
    body = (
        F.when(
            falling,
            F.concat(
                F.lit("Blended CAC is down "),
                fixed(F.abs(delta), 0),
                F.lit("% in the last 14 days — you're acquiring customers cheaper."),
            ),
        )
        .when(
            rising,
            F.concat(
                F.lit("Blended CAC is up "),
                fixed(delta, 0),
                F.lit("% in the last 14 days. Watch your least efficient channel."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Blended CAC is holding steady at "),
                currency_text(F.col("cac")),
                F.lit("."),
            )
        )
    )
    tone = F.when(falling, POSITIVE).when(rising, NEGATIVE).otherwise(NEUTRAL)
    return title, body, tone


def cac_insight(overview_row: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Direction of the blended CAC over the last 14 days."""
    return overview_row.select(*_insight(4, by, *_cac_said()))


def insights(
    breakdown: DataFrame,
    profit: DataFrame,
    matrix: DataFrame,
    overview_row: DataFrame,
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """All insights that apply, in report order by ``position``."""
    parts = [
        channel_insight(breakdown, by=by),
        profit_insight(profit, by=by),
        repeat_insight(matrix, by=by),
        cac_insight(overview_row, by=by),
    ]
    return reduce(DataFrame.unionByName, parts)


def insights_of(
    orders: DataFrame,
    ads: DataFrame,
    *,
    as_of: dt.datetime | str,
    profit_as_of: dt.datetime | str | None = None,
    completed: str = kpis.PAID,
) -> DataFrame:
    """What ``insights`` says of one store, from one pass over the spend and two over the orders.

    One wide row of conditional sums answers for channels, profit and
    acquisition cost; the repeat rate takes the second pass, by customer.
    """
    row = kpis.insight_row(orders, ads, as_of=as_of, profit_as_of=profit_as_of or as_of, completed=completed)
    top, bottom = F.array_max("channels"), F.array_min("channels")
    said = [
        F.when(_differ(top, bottom), F.struct(*_insight(1, (), *_channel_said(top, bottom)))),
        F.struct(*_insight(2, (), *_profit_said())),
        F.struct(*_insight(4, (), *_cac_said())),
    ]
    wide = row.select(F.inline(F.array_compact(F.array(*said))))
    return wide.unionByName(repeat_insight(cohort_matrix_of_orders(orders, completed=completed)))


def latest_active_day(orders: DataFrame, *, completed: str = COMPLETED) -> dt.date | None:
    """The last day with revenue, from one pass over staged orders; one value comes to the driver.

    As a literal it prunes the scans of all that reports on that day.
    """
    days = completed_only(orders, completed).groupBy("order_date").agg(F.sum("gross_revenue").alias("revenue"))
    return days.where("revenue > 0").agg(F.max("order_date")).first()[0]


def morning_briefing(mer: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The latest active day's figures and a one-line summary."""
    latest = latest_day(mer.where(F.col("gross_revenue") > 0), by=by)
    profit = F.col("net_cash_profit")
    text = F.concat(
        F.lit("Briefing: Sales: $"),
        grouped(F.col("gross_revenue"), 2),
        F.lit(" | Net Profit: "),
        F.when(profit >= 0, "+").otherwise("-"),
        F.lit("$"),
        grouped(F.abs(profit), 2),
        F.lit(" | MER: "),
        multiplier_text(F.col("marketing_efficiency_ratio")),
    )
    return latest.select(
        *by,
        "date",
        "total_orders",
        "gross_revenue",
        "total_ad_spend",
        "net_cash_profit",
        "marketing_efficiency_ratio",
        "blended_cac",
        text.alias("summary"),
    )


def full_briefing(
    mer: DataFrame, pnl: DataFrame, sellers: DataFrame, *, by: Sequence[str] = (), one_day: bool = False
) -> DataFrame:
    """The briefing with the spend per channel and the best seller of the day.

    Only the latest day's rows of the two day-grain inputs are joined.
    ``one_day``: the inputs hold that day only (see ``latest_active_day``).
    """
    keys = [*by, "date"]
    day = morning_briefing(mer, by=by)
    if not one_day:
        pnl = pnl.join(day.select(*keys), keys, "left_semi")
    spend = (
        pnl.where(F.col("channel_ad_spend") > 0)
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("channel", F.col("channel_ad_spend").alias("spend")))
            ).alias("parts")
        )
        .select(
            *keys,
            F.array_join(
                F.transform(
                    "parts",
                    lambda p: F.concat(
                        p["channel"], F.lit(": "), currency_text(p["spend"], compact=True)
                    ),
                ),
                ", ",
            ).alias("spend_split"),
        )
    )
    return day.join(spend, keys, "left").join(sellers, keys, "left")


def scorecard(overview_row: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, ROAS, CAC and contribution margin as report text."""
    roas, cac = F.col("roas"), F.col("cac")
    message = F.concat(
        F.lit("Today's KPI scorecard (ROAS "),
        multiplier_text(roas),
        F.lit(" · CAC $"),
        fixed(cac, 2),
        F.lit(") was delivered."),
    )
    return overview_row.select(
        *by,
        currency_text(F.col("revenue"), compact=True).alias("revenue"),
        multiplier_text(roas).alias("blended_roas"),
        currency_text(cac).alias("blended_cac"),
        currency_text(F.col("cm1"), compact=True).alias("contribution_margin"),
        message.alias("message"),
    )
