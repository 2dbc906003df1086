from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marginlake.functions import text
from marginlake.functions.attribution import resolve_attribution
from marginlake.functions.calendar import moment, months_between, recency_days
from marginlake.functions.currency import convert_with_table, to_base
from marginlake.functions.identity import SALT_CONF, hash_identifiers, id_salt, pseudonym
from marginlake.functions.money import (
    money_sum,
    percent_change,
    ratio_or_null,
    ratio_or_zero,
)
from marginlake.functions.segments import loyalty_tier, rfm_segment, velocity_label
from tests.helpers import column, dicts, lits


def dec(v):
    return F.lit(Decimal(v)) if v is not None else F.lit(None).cast("decimal(12,2)")


SHOP = "https://shop.example/p"


@pytest.mark.parametrize(
    "url, source, tags, channel, tier, score, click",
    [
        (f"{SHOP}?fbclid=AbC", "", "x,FBA", "Amazon Marketplace", "TIER_3_MARKETPLACE", 1.0, None),
        ("", "amz_sponsored", "", "Amazon Marketplace", "TIER_3_MARKETPLACE", 1.0, None),
        (f"{SHOP}?fbclid=IwAR0912384", "", "", "Meta Ads", "TIER_1_CLICK_ID", 0.95, "iwar0912384"),
        (f"{SHOP}?gclid=G1&fbclid=F1", "", "", "Meta Ads", "TIER_1_CLICK_ID", 0.95, "f1"),
        (f"{SHOP}?gclid=Cj_9-x", "tiktok", "", "Google Ads", "TIER_1_CLICK_ID", 0.95, "cj_9-x"),
        (f"{SHOP}?wbraid=Zz9", "", "", "Google Ads", "TIER_1_CLICK_ID", 0.95, None),
        (f"{SHOP}?ttclid=T-1", "", "", "TikTok Ads", "TIER_1_CLICK_ID", 0.95, "t-1"),
        (SHOP, "Instagram", "", "Meta Ads", "TIER_2_UTM", 0.80, None),
        (SHOP, "campaign_x", "", "Meta Ads", "TIER_2_UTM", 0.80, None),
        (SHOP, "youtube", "", "Google Ads", "TIER_2_UTM", 0.80, None),
        (SHOP, "tiktok_ads", "", "TikTok Ads", "TIER_2_UTM", 0.80, None),
        (SHOP, "klaviyo", "", "Organic, Direct & Klaviyo Email", "TIER_2_UTM_RETENTION", 0.90, None),
        (SHOP, "", "retail", "Organic, Direct & Klaviyo Email", "TIER_4_DIRECT_ORGANIC", 0.70, None),
        (None, None, None, "Organic, Direct & Klaviyo Email", "TIER_4_DIRECT_ORGANIC", 0.70, None),
    ],
)
def test_attribution_rules(spark, url, source, tags, channel, tier, score, click):
    got = column(spark, resolve_attribution(*lits(url, source, tags)))
    assert tuple(got) == (channel, tier, score, click)


def test_attribution_options(spark):
    strict = column(spark, resolve_attribution(*lits(SHOP, "campaign_x", ""), strict=True))
    assert strict.attribution_tier == "TIER_4_DIRECT_ORGANIC"
    assert column(spark, resolve_attribution(*lits(SHOP, "ig-story", ""), strict=True)).channel == "Meta Ads"
    kept = column(
        spark, resolve_attribution(*lits(f"{SHOP}?fbclid=IwAR09", "", ""), preserve_case=True)
    )
    assert kept.click_id == "IwAR09"


@pytest.mark.parametrize(
    "amount, code, usd",
    [
        ("100.00", "USD", "100.00"),
        ("100.00", "EUR", "108.00"),
        ("100.00", " eur ", "108.00"),
        ("1000.00", "INR", "11.90"),
        ("10.00", "XXX", "10.00"),
        ("0.25", "CAD", "0.19"),
        ("10.00", None, "10.00"),
    ],
)
def test_currency(spark, amount, code, usd):
    got = column(spark, to_base(dec(amount), F.lit(code).cast("string")))
    assert got == Decimal(usd)


def test_currency_other_base_and_table(spark):
    got = column(spark, to_base(dec("128.00"), F.lit("GBP"), base="EUR"))
    assert got == Decimal("151.70")  # 128 * 1.28 / 1.08
    df = spark.createDataFrame([("a", "eur", Decimal("2.00")), ("b", "zzz", Decimal("2.00"))], "id string, cur string, amt decimal(12,2)")
    rates = spark.createDataFrame([("EUR", 1.5)], "code string, rate double")
    out = dicts(convert_with_table(df, rates, amount="amt", currency="cur", out="usd"), "id")
    assert [r["usd"] for r in out] == [Decimal("3.00"), Decimal("2.00")]


def test_pseudonym(spark):
    assert column(spark, pseudonym(F.lit("42"), "salt")) == "CUST_b0c8fbfacd557d94"
    assert column(spark, pseudonym(F.lit(None), "salt")) is None
    df = spark.createDataFrame([("a@x", "42", 1)], "email string, id string, n int")
    row = hash_identifiers(df, ["email", "id"], "salt").collect()[0]
    assert row.id == "CUST_b0c8fbfacd557d94" and row.email.startswith("CUST_") and row.n == 1


def test_salt_comes_from_settings(spark):
    with pytest.raises(ValueError):
        id_salt(spark)
    spark.conf.set(SALT_CONF, "pepper")
    assert id_salt(spark) == "pepper"
    spark.conf.unset(SALT_CONF)


@pytest.mark.parametrize(
    "orders, spend, recency, segment",
    [
        (1, "399.99", 0, "new"),
        (1, "400.00", 500, "vip"),
        (3, "10", 0, "loyal"),
        (4, "10", 500, "vip"),
        (2, "10", 121, "lost"),
        (2, "10", 120, "at_risk"),
        (2, "10", 61, "at_risk"),
        (2, "10", 60, "loyal"),
        (1, "10", 30, "new"),
        (1, "10", 31, "active"),
        (1, "150", 31, "promising"),
        (0, "149.99", 10, "active"),
        (0, "150", 10, "promising"),
    ],
)
def test_rfm_rules(spark, orders, spend, recency, segment):
    got = column(spark, rfm_segment(F.lit(orders), dec(spend), F.lit(recency)))
    assert got == segment


def test_tiers_and_velocity(spark):
    tiers = [column(spark, loyalty_tier(F.lit(n))) for n in (1, 2, 3, 4)]
    assert tiers == ["One-Time Buyer", "Loyal Customer", "Loyal Customer", "Champion (VIP)"]
    speeds = [column(spark, velocity_label(dec(v))).split()[0] for v in ("5.00", "5.01", "15.00", "15.01")]
    assert speeds == ["Low", "Moderate", "Moderate", "High"]


def test_safe_division(spark):
    assert column(spark, ratio_or_null(dec("1"), dec("0"))) is None
    assert column(spark, ratio_or_zero(dec("1"), dec("0"))) == 0
    assert column(spark, ratio_or_zero(dec("1"), dec("-2"))) == 0
    assert column(spark, ratio_or_zero(dec("1"), dec(None))) == 0
    assert column(spark, ratio_or_null(dec("1"), dec("8"))) == Decimal("0.13")  # half up
    assert column(spark, ratio_or_null(dec("-1"), dec("8"))) == Decimal("-0.13")
    assert column(spark, percent_change(dec("5"), dec("0"))) == 0.0
    assert column(spark, percent_change(dec("5"), dec("4"))) == 25.0


def test_money_sum_is_exact(spark):
    df = spark.range(1000).select(F.lit(Decimal("0.10")).alias("x"))
    assert df.agg(money_sum("x").alias("s")).collect()[0].s == Decimal("100.00")
    assert df.where("id < 0").agg(money_sum("x").alias("s")).collect()[0].s is None


def test_calendar(spark):
    months = column(spark, months_between(F.lit("2025-02-01").cast("date"), F.lit("2023-11-30").cast("date")))
    assert months == 15
    as_of = moment("2025-07-01 00:00:00")
    for last, days in (("2025-06-30 12:00:00", 1), ("2025-06-30 12:00:01", 0), ("2025-07-01 12:00:00", 0), ("2025-05-02 00:00:00", 60)):
        assert column(spark, recency_days(as_of, F.lit(last).cast("timestamp"))) == days


@pytest.mark.parametrize(
    "value, plain, compact",
    [
        ("0", "$0.00", "$0.00"),
        ("99.994", "$99.99", "$99.99"),
        ("99.999", "$100.00", "$100.00"),
        ("100.5", "$101", "$101"),
        ("-1234.4", "-$1,234", "-$1.2k"),
        ("1250", "$1,250", "$1.3k"),
        ("2345678", "$2,345,678", "$2.35M"),
        ("1234567890", "$1,234,567,890", "$1234.57M"),
    ],
)
def test_currency_text(spark, value, plain, compact):
    assert column(spark, text.currency_text(dec(value))) == plain
    assert column(spark, text.currency_text(dec(value), compact=True)) == compact


def test_other_text(spark):
    assert column(spark, text.number_text(F.lit(1234567))) == "1,234,567"
    assert column(spark, text.percent_text(F.lit(12.345))) == "12.3%"
    assert column(spark, text.multiplier_text(F.lit(3.0))) == "3.00x"
    assert column(spark, text.month_label(F.lit("2025-01-31").cast("date"))) == "Jan 25"
    assert column(spark, text.day_label(F.lit("2025-01-05").cast("date"))) == "Jan 5"


def test_amounts_are_summed_by_the_cent_whatever_their_type(spark):
    doubles = spark.createDataFrame([(0.29,), (1.005,), (-0.29,)], "x double")
    assert doubles.agg(money_sum("x").alias("s")).collect()[0].s == Decimal("1.00")
    fine = spark.createDataFrame([(Decimal("0.0199"),)] * 100, "x decimal(10,4)")
    assert fine.agg(money_sum("x").alias("s")).collect()[0].s == Decimal("2.00")


def test_number_text_keeps_three_decimals(spark):
    for value, want in ((1234.567, "1,234.567"), (1234.5, "1,234.5"), (1200.0, "1,200"), (0.0004, "0")):
        assert column(spark, text.number_text(F.lit(value))) == want


def test_unknown_codes_pass_in_any_base(spark):
    assert column(spark, to_base(dec("10.00"), F.lit("XYZ"), base="EUR")) == Decimal("10.00")
    df = spark.createDataFrame([(1, Decimal("108.00"), "usd"), (2, Decimal("7.00"), "XYZ"), (3, Decimal("5.00"), "eur"), (4, Decimal("1.00"), None)], "id int, amt decimal(12,2), cur string")
    rates = spark.createDataFrame([("EUR", "1.08"), ("eur ", "1.08"), ("USD", "1.0")], "code string, rate string")
    out = dicts(convert_with_table(df, rates, amount="amt", currency="cur", out="v", base="EUR"), "id")
    assert [r["v"] for r in out] == [Decimal("100.00"), Decimal("7.00"), Decimal("5.00"), Decimal("1.00")]


def test_salt_stays_out_of_plan_texts(spark):
    from marginlake.functions.identity import SALT_CONF, pseudonym
    from marginlake.session import build_session

    old = spark.conf.get("spark.sql.redaction.string.regex", None)
    try:
        build_session(**{SALT_CONF: "pepper77"})  # the running session takes the settings
        plan = spark.range(1).select(pseudonym(F.col("id"), "pepper77").alias("x"))
        text_of = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "pepper77" not in text_of and "redacted" in text_of
    finally:
        spark.conf.unset(SALT_CONF)
        spark.conf.unset("spark.sql.redaction.string.regex") if old is None else spark.conf.set("spark.sql.redaction.string.regex", old)
