"""Validation of orders and ad spend: typed rows out, bad rows to quarantine with their reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marginlake.functions.money import default_cogs


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    default: str | None = None
    required: bool = False
    max_length: int | None = None


# The order fields with their limits and defaults.
ORDER_FIELDS = (
    Field("order_id", "string", required=True, max_length=100),
    Field("customer_id", "string", required=True, max_length=100),
    Field("order_date", "timestamp", required=True),
    Field("gross_revenue", "decimal(12,2)", required=True),
    Field("cogs", "decimal(12,2)"),  # default: 35 % of revenue
    Field("shipping_cost", "decimal(10,2)", default="0"),
    Field("taxes", "decimal(10,2)", default="0"),
    Field("discounts", "decimal(10,2)", default="0"),
    Field("acquisition_channel", "string", default="Organic / Direct", max_length=100),
    Field("status", "string", default="Completed", max_length=50),
    Field("landing_site", "string", default=""),
    Field("currency", "string", default="USD", max_length=10),
)


# The ad-spend fields with their limits and defaults.
AD_SPEND_FIELDS = (
    Field("date", "date", required=True),
    Field("channel", "string", required=True, max_length=100),
    Field("spend", "decimal(12,2)", default="0"),
    Field("clicks", "bigint", default="0"),
    Field("impressions", "bigint", default="0"),
)

#: Where readers put a record that is none (broken JSON, a line of other columns).
CORRUPT = "_corrupt_record"

FULL_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"


def _text(df: DataFrame, f: Field) -> Column:
    """The raw cell as text, NULL when the column or the value is missing."""
    if f.name not in df.columns:
        return F.lit(None).cast("string")
    text = F.col(f.name).cast("string")
    if f.type == "string":
        return F.trim(text) if f.required else text
    text = F.trim(text)
    if f.required:
        return text
    return F.when(F.lower(text).isin("", "nan"), F.lit(None)).otherwise(text)


def _is_bad(f: Field, text: Column) -> Column:
    """Whether the cell cannot be stored: one test per cell, no message.

    Kept small on purpose: the tests of all cells form one filter, which has to
    stay within what the JVM compiles as a single method.
    """
    if f.type == "string":
        if f.required:
            return ~F.coalesce(F.length(text).between(1, f.max_length), F.lit(False))
        if f.max_length is None:
            return F.lit(False)
        return F.coalesce(F.length(text) > f.max_length, F.lit(False))
    unreadable = text.try_cast(f.type).isNull()
    if f.type in ("timestamp", "date"):  # a bare time or year is no date
        unreadable = unreadable | ~text.rlike(FULL_DATE)
    return unreadable if f.required else text.isNotNull() & unreadable


def _reason(f: Field, text: Column) -> Column:
    """Why a bad cell cannot be stored, NULL for a good one."""
    if f.type == "string":
        why = F.lit(f"{f.name}: longer than {f.max_length}")
    elif f.type in ("timestamp", "date"):
        why = F.concat(F.lit(f"{f.name}: not a {f.type}: "), text)
    else:
        number = text.try_cast("double")
        what = F.when(number.isNull() | F.isnan(number), "not a number").otherwise("out of range")
        why = F.concat(F.lit(f"{f.name}: "), what, F.lit(": "), text)
    missing = F.when(text.isNull() | (text == ""), F.lit(f"{f.name}: missing"))
    return F.when(_is_bad(f, text), missing.otherwise(why))


def _check(
    raw: DataFrame, fields: tuple[Field, ...], keep: tuple[str, ...], fill: dict[str, Callable[[dict[str, Column]], Column]]
) -> DataFrame:
    cells = {f.name: _text(raw, f) for f in fields}
    bad = reduce(or_, [_is_bad(f, cells[f.name]) for f in fields])
    reasons = F.array(*[_reason(f, cells[f.name]) for f in fields])
    if CORRUPT in raw.columns:
        broken = F.col(CORRUPT).isNotNull()
        bad = broken | bad
        reasons = F.when(broken, F.array(F.lit("malformed record"))).otherwise(reasons)
    typed = []
    for f in fields:
        value = cells[f.name] if f.type == "string" else cells[f.name].try_cast(f.type)
        if f.name in fill:
            value = F.coalesce(value, fill[f.name](cells))
        elif f.default is not None:
            value = F.coalesce(value, F.lit(f.default).cast(f.type))
        typed.append(value.alias(f.name))
    payload = F.to_json(F.struct(*[F.col(c) for c in raw.columns if c not in keep]))
    return raw.select(
        *typed,
        *keep,
        (~bad).alias("_ok"),
        F.array_compact(reasons).alias("_reasons"),
        payload.alias("_payload"),
    )


def check_orders(raw: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed order columns plus ``_ok``, ``_reasons`` (array) and ``_payload`` (the raw row).

    Pure column expressions: one narrow projection, no shuffle, no Python. Reasons
    and payload are only computed where the dead letters are read.
    """
    cogs = lambda cells: default_cogs(cells["gross_revenue"].try_cast("decimal(12,2)"))
    return _check(raw, ORDER_FIELDS, keep, {"cogs": cogs})


def check_ad_spend(raw: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for ad spend: date, channel, spend, clicks, impressions."""
    return _check(raw, AD_SPEND_FIELDS, keep, {})


def good_orders(checked: DataFrame) -> DataFrame:
    """The typed rows that passed, of orders or of ad spend."""
    return checked.where("_ok").drop("_ok", "_reasons", "_payload")


def quarantined(checked: DataFrame, source: str) -> DataFrame:
    """Dead-letter rows: source_system, raw_payload, error_reason, failed_at."""
    return checked.where("not _ok").select(
        F.lit(source).alias("source_system"),
        F.col("_payload").alias("raw_payload"),
        F.array_join("_reasons", "; ").alias("error_reason"),
        F.current_timestamp().alias("failed_at"),
    )


def split_orders(raw: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters); every input row is in exactly one of them."""
    checked = check_orders(raw)
    return good_orders(checked), quarantined(checked, source)


def split_ad_spend(raw: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of ad-spend rows."""
    checked = check_ad_spend(raw)
    return good_orders(checked), quarantined(checked, source)


def _counters() -> list[Column]:
    return [F.count_if(F.col("_ok")).alias("successful"), F.count_if(~F.col("_ok")).alias("quarantined")]


def ingest_counters(checked: DataFrame) -> DataFrame:
    """One row: successful and quarantined row counts (duplicates count, empty gives 0)."""
    return checked.agg(*_counters())


def counted(checked: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """``checked`` as it is, and its counters once an action has read it whole: no second scan.

    ``Observation.get`` holds successful and quarantined after the first write.
    """
    observation = Observation(name)
    return checked.observe(observation, *_counters()), observation
