"""Registered queries: operator name -> callable(spark, sf_dir) -> DataFrame.

Every query runs its operator over whole sample tables. ``publish`` turns results
into plain types (decimals to double, dates to text) for comparison with SQL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginlake.functions import text
from marginlake.functions.calendar import moment
from marginlake.functions.currency import FX_RATES, convert_with_table, to_base
from marginlake.functions.identity import hash_identifiers, pseudonym
from marginlake.operators import (
    attribution,
    customers,
    detect,
    insights,
    kpis,
    logs,
    marts,
    sketches,
    skus,
    staging,
)
from marginlake.plans import bindings as b
from marginlake.plans import warehouse
from marginlake.schemas import ORDER_EVENT
from marginlake.session import setting, work_dir
from marginlake.sources import files, merge, sinks, store, validate
from marginlake.streaming import billing, changelog, ingest, live, throttle, throttle_live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, with published types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return publish(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def publish(df: DataFrame) -> DataFrame:
    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


VIEW_TOTALS = {
    "stg_orders": "net_margin",
    "stg_ad_spend": "ad_spend",
    "fct_daily_unit_economics": "net_profit",
    "fct_channel_attributed_pnl": "channel_net_profit",
    "fct_product_profitability": "total_net_profit",
    "fct_multi_touch_attribution": "attributed_revenue",
    "fct_inventory_runway": "daily_burn_velocity",
    "fct_customer_cohort_retention": "cohort_net_profit",
    "fct_subscription_churn_velocity": "cycle_gross_revenue",
    "fct_marketing_efficiency_ratio": "net_cash_profit",
    "dim_customer_ltv": "lifetime_revenue",
}

# -- shared inputs -----------------------------------------------------------


def _store(spark: SparkSession, sf: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    return (
        staging.stage_orders(b.store_orders(spark, sf), by=by),
        staging.stage_ad_spend(b.store_ad_spend(spark, sf), by=by),
    )


def _half_year(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return b.half_year_orders(spark, sf), b.half_year_ad_spend(spark, sf)


def _tenants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"ws{k}",) for k in range(4)], "workspace_id string")


def _half_year_daily(spark: SparkSession, sf: str) -> DataFrame:
    o, a = _half_year(spark, sf)
    return marts.daily_unit_economics(
        staging.stage_orders(o, completed="paid"), staging.stage_ad_spend(a), completed="paid"
    )


def _overview(spark: SparkSession, sf: str, as_of: str = b.AS_OF) -> DataFrame:
    return kpis.overview(*_half_year(spark, sf), as_of=as_of)


def _segmented(spark: SparkSession, sf: str) -> DataFrame:
    rolled = customers.customer_rollup(b.half_year_orders(spark, sf))
    return customers.segment_customers(rolled, as_of=moment(b.AS_OF))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    o = b.half_year_orders(spark, sf)
    return customers.cohort_matrix(customers.customer_rollup(o), o)


def _mer(spark: SparkSession, sf: str) -> DataFrame:
    return marts.marketing_efficiency(marts.daily_unit_economics(*_store(spark, sf)))


# -- sources, validation, merge, sinks ---------------------------------------


def _spend_csv(spark, sf):
    """Ad spend as CSV files, some cells broken."""
    path = work_dir(spark, "ad-spend-csv")
    rows = b.store_ad_spend(spark, sf).select("date", "channel", "spend", "clicks", "impressions")
    bad = F.col("clicks") % 50 == 49
    rows = rows.withColumn("spend", F.when(bad, F.lit("n/a")).otherwise(F.col("spend").cast("string")))
    rows.write.option("header", True).csv(path)
    return files.read_ad_spend_csv(spark, path)


@query
def a1_ad_spend_csv(spark, sf):
    good, _ = validate.split_ad_spend(_spend_csv(spark, sf), "ad_spend_csv")
    return good.groupBy("date", "channel").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("spend").alias("spend"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
    )


@query
def a1_quarantine(spark, sf):
    _, dead = validate.split_ad_spend(_spend_csv(spark, sf), "ad_spend_csv")
    return dead.groupBy("source_system", "error_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def a2_orders_export(spark, sf):
    path = work_dir(spark, "orders-export")
    headings = {"Name": "order_id", "Buyer": "customer_id", "Paid at": "order_date", "Total": "gross_revenue"}
    feed = b.raw_order_feed(spark, sf)
    feed.select(*[F.col(c).alias(h) for h, c in headings.items()]).write.option("header", True).csv(path)
    good, _ = validate.split_orders(files.read_orders_export(spark, path, headings), "orders_export")
    return good.drop("landing_site")


@query
def a2_quarantine(spark, sf):
    """Lines with a thousands separator nobody quoted: a cell too many."""
    path = work_dir(spark, "broken-export")
    feed = b.raw_order_feed(spark, sf).where("gross_revenue <> 'ten' and order_date <> 'someday'")
    key = F.col("order_id").cast("long")
    total = F.when(key % 53 == 0, F.concat(F.lit("1,"), F.col("gross_revenue"))).otherwise(F.col("gross_revenue"))
    lines = feed.select((key % 8).alias("part"), key.alias("line"), F.concat_ws(",", "order_id", "customer_id", "order_date", total).alias("value"))
    heads = spark.range(8).select(F.col("id").alias("part"), F.lit(-1).alias("line"), F.lit("order_id,customer_id,order_date,gross_revenue").alias("value"))
    rows = lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "line")
    rows.select("part", "value").write.partitionBy("part").text(path)
    good, dead = validate.split_orders(files.read_orders_export(spark, path), "orders_export")
    taken = good.agg(F.lit("orders_export").alias("source_system"), F.lit("good").alias("error_reason"), F.count(F.lit(1)).alias("n"))
    return _reasons(dead).unionByName(taken)


def _landed(df: DataFrame, body: Column, broken: Column, name: str) -> str:
    """JSON documents of one page each as files; where ``broken``, cut off in the middle."""
    path = work_dir(df.sparkSession, name)
    text = F.to_json(body)
    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    df.select(F.when(broken, half).otherwise(text).alias("value")).write.text(path)
    return path


ORDER_CELLS = (
    "order_id", "customer_id", "order_date", "gross_revenue", "cogs", "shipping_cost", "acquisition_channel", "status",
)


def _reasons(dead: DataFrame) -> DataFrame:
    return dead.groupBy("source_system", "error_reason").agg(F.count(F.lit(1)).alias("n"))


def _storefront_pages(spark, sf) -> tuple[Column, Column]:
    """A page for each row of ``orders``, and whether it is cut off."""
    key = F.col("o_orderkey")
    price = F.when(key % 89 == 0, "BAD").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    page = F.struct(
        F.array(
            F.struct(
                key.cast("string").alias("id"),
                F.when(F.col("o_orderstatus") != "O", F.struct(F.col("o_custkey").cast("string").alias("id"))).alias("customer"),
                price.alias("total_price"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
                F.when(
                    F.col("o_orderpriority") == "1-URGENT",
                    F.struct(F.struct(F.lit("9.50").alias("amount")).alias("shop_money")),
                ).alias("total_shipping_price_set"),
                F.when(F.col("o_orderpriority") == "2-HIGH", "pos").alias("source_name"),
                F.when(F.col("o_orderstatus") == "P", "refunded").otherwise("paid").alias("financial_status"),
            )
        ).alias("orders")
    )
    return page, key % 97 == 0


def _storefront(spark, sf):
    path = _landed(b.table(spark, sf, "orders"), *_storefront_pages(spark, sf), "storefront")
    rows = files.storefront_orders(files.read_storefront_pages(spark, path))
    return validate.split_orders(rows, "storefront")


@query
def a3_storefront_orders(spark, sf):
    return _storefront(spark, sf)[0].select(*ORDER_CELLS)


@query
def a3_quarantine(spark, sf):
    """Broken pages and broken prices."""
    return _reasons(_storefront(spark, sf)[1])


def _insights(spark, sf):
    part = F.col("l_partkey")
    day = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_start"),
        F.when(part % 83 == 0, "1,5").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("spend"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("long").cast("string")).alias("impressions"),
        F.col("l_linenumber").cast("string").alias("clicks"),
    )
    lines = b.table(spark, sf, "lineitem")
    path = _landed(lines, F.struct(F.array(day).alias("data")), F.lit(False), "insights")
    rows = files.ad_insights(files.read_insights_pages(spark, path), as_of=dt.date(2001, 6, 30), days_back=365)
    return validate.split_ad_spend(rows, "insights")


def _waves(df: DataFrame, part: Column, path: str, *, waves: int, run: Callable[[], None]) -> None:
    """Land rows in ``waves`` appends by ``part`` (0, 1, ...), many files each; ``run`` a stream after each."""
    for k in range(waves):
        df.where(part == k).write.mode("append").text(path)
        run()


@query
def a3_stream_orders(spark, sf):
    """Order pages that land in three waves, some cut off in the middle, through the order store."""
    root = work_dir(spark, "storefront-stream")
    pages, broken = _storefront_pages(spark, sf)
    text = F.to_json(pages)
    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    rows = b.table(spark, sf, "orders").select(F.when(broken, half).otherwise(text).alias("value"))

    def run() -> None:
        feed = files.storefront_orders(files.stream_storefront_pages(spark, f"{root}/in"))
        seq = F.coalesce(F.col("order_id").try_cast("long"), F.lit(0)).alias("_seq")
        ingest.ingest_orders(feed.select("*", seq), root, f"{root}/checkpoint", source="storefront").awaitTermination()

    _waves(rows, F.pmod(F.hash("value"), F.lit(3)), f"{root}/in", waves=3, run=run)
    good = changelog.current_orders(spark, root).select(*ORDER_CELLS)
    dead = changelog.dead_letters(spark, root).groupBy("error_reason").agg(F.count(F.lit(1)).alias("n"))
    told = dead.select(F.col("error_reason").alias("order_id"), F.col("n").cast("string").alias("customer_id"))
    return good.unionByName(told, allowMissingColumns=True)


@query
def a5_stream_quarantine(spark, sf):
    """Webhook events that land in two waves, some cut off: what the order store took and what it refused."""
    root = work_dir(spark, "webhook-stream")
    body = F.to_json(F.struct(*_event_cells(), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("arrived_at")))
    cut = F.col("event_id") % 97 == 0
    rows = b.table(spark, sf, "events").select(F.when(cut, F.substring(body, 1, 20)).otherwise(body).alias("value"))

    def run() -> None:
        events = files.stream_order_events(spark, f"{root}/in")
        feed = files.order_events(events, salt=b.SALT, arrived="arrived_at")
        ingest.ingest_orders(feed.withColumn("_seq", F.lit(0).cast("long")), root, f"{root}/checkpoint", source="webhook").awaitTermination()

    _waves(rows, F.pmod(F.hash("value"), F.lit(2)), f"{root}/in", waves=2, run=run)
    taken = changelog.current_orders(spark, root).agg(
        F.lit("webhook").alias("source_system"), F.lit("good").alias("error_reason"), F.count(F.lit(1)).alias("n")
    )
    return _reasons(changelog.dead_letters(spark, root)).unionByName(taken)


@query
def a4_ad_insights(spark, sf):
    return _insights(spark, sf)[0].groupBy("date", "channel").agg(
        *[F.sum(c).alias(c) for c in ("spend", "clicks", "impressions")]
    )


@query
def a4_quarantine(spark, sf):
    return _reasons(_insights(spark, sf)[1])


def _event_cells() -> list[Column]:
    value = F.when(F.col("event_id") % 79 == 0, "BAD").otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    return [
        F.when(F.col("event_type") != "view", F.col("event_id").cast("string")).alias("order_id"),
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("customer_id"),
        F.when(F.col("event_type") != "click", value).alias("gross_revenue"),
    ]


def _order_events(spark, sf):
    landed = b.table(spark, sf, "events").select(F.to_json(F.struct(*_event_cells())).alias("body"), "ts")
    events = landed.select(F.from_json("body", ORDER_EVENT).alias("e"), "ts").select("e.*", "ts")
    return validate.split_orders(files.order_events(events, salt=b.SALT, arrived="ts"), "webhook")


@query
def a5_order_events(spark, sf):
    return _order_events(spark, sf)[0].select(*ORDER_CELLS)


@query
def a5_quarantine(spark, sf):
    return _reasons(_order_events(spark, sf)[1])


@query
def a7_workspace_scan(spark, sf):
    """All tenants in one scan, and one of them by itself."""
    o = b.store_orders(spark, sf)
    sums = F.count(F.lit(1)).alias("orders"), F.sum("gross_revenue").alias("revenue")
    everyone = o.groupBy("workspace_id").agg(*sums)
    alone = staging.for_workspace(o, "ws1").agg(*sums).select(F.lit("ws1 alone").alias("workspace_id"), "orders", "revenue")
    return everyone.unionByName(alone)


@query
def a8_good_orders(spark, sf):
    return validate.split_orders(b.raw_order_feed(spark, sf), "feed")[0]


@query
def a8_quarantine(spark, sf):
    dead = validate.split_orders(b.raw_order_feed(spark, sf), "feed")[1]
    return dead.select(
        "source_system",
        "error_reason",
        *[
            F.get_json_object("raw_payload", f"$.{c}").alias(c)
            for c in ("order_id", "customer_id", "order_date", "gross_revenue")
        ],
    )


def _merge_sides(spark, sf):
    """A store without TikTok orders, and a feed that brings all but Meta's, twice:
    unchanged first, then with every column changed."""
    o = b.store_orders(spark, sf).drop("workspace_id")
    channel = F.col("acquisition_channel")
    target = o.where(~channel.eqNullSafe("TikTok Ads"))
    first = o.where(~channel.eqNullSafe("Meta Ads")).withColumn("seq", F.lit(1))
    second = first.withColumns(
        {
            "seq": F.lit(2),
            "customer_id": F.concat("customer_id", F.lit("-new")),
            "order_date": F.col("order_date") + F.expr("INTERVAL 1 DAY"),
            "gross_revenue": (F.col("gross_revenue") + 1).cast("decimal(12,2)"),
            "status": F.lit("Refunded"),
        }
    )
    return target, first.unionByName(second)


@query
def a9_upsert(spark, sf):
    target, batch = _merge_sides(spark, sf)
    return merge.upsert_orders(target, batch, seq=["seq"])


@query
def a9_stored(spark, sf):
    """The same merge into a stored table: two batches, one of them run again."""
    target, batch = _merge_sides(spark, sf)
    root = work_dir(spark, "orders-store")
    store.create(target, root, key=["order_id"], buckets=16)
    for k in (0, 1, 1):
        store.merge_orders(batch.where(F.col("seq") == k + 1), root, k, seq=["seq"])
    return store.read(spark, root)


@query
def a10_write_counters(spark, sf):
    """Counters that come with the write of good rows and dead letters."""
    counts = sinks.save_checked(validate.check_orders(b.raw_order_feed(spark, sf)), work_dir(spark, "checked"), "feed")
    return spark.createDataFrame([(counts["successful"], counts["quarantined"])], "successful long, quarantined long")


@query
def a10_ingest_counters(spark, sf):
    return validate.ingest_counters(validate.check_orders(b.raw_order_feed(spark, sf)))


@query
def a11_customers_export(spark, sf):
    path = work_dir(spark, "customers-csv")
    rolled = customers.customer_rollup(b.half_year_orders(spark, sf)).withColumns(
        {
            "name": F.concat(F.lit('Buyer "'), "customer_id", F.lit('", Esq.')),
            "email": F.concat("customer_id", F.lit("@example.com")),
        }
    )
    sinks.export_customers_csv(rolled, path, as_of=moment(b.AS_OF))
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query
def a12_orders_export_csv(spark, sf):
    path = work_dir(spark, "orders-csv")
    sinks.export_orders_csv(b.half_year_orders(spark, sf), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query
def a13_mart_views(spark, sf):
    warehouse.register_views(b.store_orders(spark, sf), b.store_ad_spend(spark, sf))
    return spark.sql(
        """
        select l.customer_segment, count(*) as customers,
               sum(l.lifetime_revenue) as lifetime_revenue,
               max(s.last_month) as last_month
        from dim_customer_ltv l
        cross join (select max(cohort_month) as last_month from fct_customer_cohort_retention) s
        group by l.customer_segment
        """
    )


@query
def a13_all_views(spark, sf):
    """Rows and one total of every view."""
    warehouse.register_views(b.store_orders(spark, sf), b.store_ad_spend(spark, sf))
    parts = [
        f"select '{view}' as mart, count(*) as rows, cast(sum({column}) as double) as total from {view}"
        for view, column in VIEW_TOTALS.items()
    ]
    return spark.sql(" union all ".join(parts))


@query
def a14_alert_sink(spark, sf):
    path = work_dir(spark, "alerts")
    daily = marts.daily_unit_economics(*_store(spark, sf))
    sinks.append_alerts(detect.loss_alerts(daily), path)
    return spark.read.parquet(path)


@query
def a14_alerts_once(spark, sf):
    """The scan of a first half of the days, run twice, then that of all days: each alert is there once."""
    path = work_dir(spark, "alerts-once")
    alerts = detect.loss_alerts(marts.daily_unit_economics(*_store(spark, sf)))
    for k, rows in ((0, alerts.where("day(date) < 16")), (0, alerts.where("day(date) < 16")), (1, alerts)):
        sinks.save_alerts(rows, path, k)
    return sinks.read_alerts(spark, path).drop("alert_key", "batch")


@query
def a13_refreshed_days(spark, sf):
    """Two marts stored by day: some days are stored wrong, then refreshed, then all views are read back."""
    o, a = _store(spark, sf)
    raw = b.store_orders(spark, sf)
    wrong = F.dayofmonth("order_date") % 10 == 3
    spoilt = staging.stage_orders(
        raw.withColumn("gross_revenue", F.when(wrong, F.col("gross_revenue") + 1).otherwise(F.col("gross_revenue")).cast("decimal(12,2)"))
    )
    days = o.where(wrong).select(F.col("order_date").alias("date")).distinct()
    of_days = lambda df, at: df.join(days, df[at] == days["date"], "left_semi")
    frames = warehouse.mart_frames(raw, b.store_ad_spend(spark, sf))
    for name, mart in (("fct_daily_unit_economics", marts.daily_unit_economics), ("fct_channel_attributed_pnl", marts.channel_pnl)):
        path = work_dir(spark, name)
        sinks.save_mart(mart(spoilt, a), path, partition_by=["date"])
        sinks.refresh_days(mart(of_days(o, "order_date"), of_days(a, "ad_date")), days, path)
        frames[name] = spark.read.parquet(path)
    frames["fct_marketing_efficiency_ratio"] = marts.marketing_efficiency(frames["fct_daily_unit_economics"])
    parts = [
        frames[view].agg(F.lit(view).alias("mart"), F.count(F.lit(1)).alias("rows"), F.sum(column).cast("double").alias("total"))
        for view, column in VIEW_TOTALS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _ad_spend_sides(spark, sf):
    measures = [F.sum(c).alias(c) for c in ("spend", "impressions", "clicks")]
    rows = b.store_ad_spend(spark, sf).groupBy("date", "channel", "campaign_id").agg(*measures)
    total = files.ad_spend_rows(rows).drop("campaign_name", "conversions")
    target = total.where(F.col("channel") != "TikTok Ads")
    def version(seq: int, factor: int) -> DataFrame:
        spend = (F.col("spend") * factor).cast("decimal(12,2)")
        return total.where(F.col("channel") != "Meta Ads").withColumns({"seq": F.lit(seq), "spend": spend})

    # Every key comes twice, the later version first.
    return target, version(2, 2).unionByName(version(1, 3))


@query
def a15_ad_spend_upsert(spark, sf):
    target, batch = _ad_spend_sides(spark, sf)
    return merge.upsert_ad_spend(target, batch, seq=["seq"])


@query
def a15_stored(spark, sf):
    """The same merge into a stored table, run again."""
    target, batch = _ad_spend_sides(spark, sf)
    root = work_dir(spark, "ad-spend-store")
    store.create(target, root, key=["date", "channel", "campaign_id"], buckets=16)
    for _ in range(2):
        store.merge_ad_spend(batch, root, 0, seq=["seq"])
    return store.read(spark, root)


# -- staging and marts ---------------------------------------------------------


@query
def b1_stg_orders(spark, sf):
    return _store(spark, sf)[0]


@query
def b2_stg_ad_spend(spark, sf):
    return _store(spark, sf)[1]


@query
def d1_daily_unit_economics(spark, sf):
    return marts.daily_unit_economics(*_store(spark, sf))


@query
def d1_daily_unit_economics_keyed(spark, sf):
    return marts.daily_unit_economics(*_store(spark, sf), unique_ids=True)


@query
def d1_daily_extended(spark, sf):
    return marts.daily_unit_economics(*_store(spark, sf), extended=True)


@query
def d1_daily_by_workspace(spark, sf):
    by = ("workspace_id",)
    return marts.daily_unit_economics(*_store(spark, sf, by), by=by)


@query
def d2_channel_pnl(spark, sf):
    return marts.channel_pnl(*_store(spark, sf))


@query
def d3_channel_profitability(spark, sf):
    return marts.channel_profitability(_store(spark, sf)[0])


@query
def d4_attribution_share(spark, sf):
    return marts.attribution_share(_store(spark, sf)[0])


@query
def d5_velocity(spark, sf):
    return marts.sales_velocity(_store(spark, sf)[0])


@query
def d5_velocity_keyed(spark, sf):
    return marts.sales_velocity(_store(spark, sf)[0], unique_ids=True)


@query
def d6_customer_ltv(spark, sf):
    return customers.customer_ltv(_store(spark, sf)[0])


@query
def d7_cohort_retention(spark, sf):
    return customers.cohort_retention(_store(spark, sf)[0])


@query
def d8_cycle_churn(spark, sf):
    return customers.cycle_churn(_store(spark, sf)[0])


@query
def d9_mer(spark, sf):
    return _mer(spark, sf)


@query
def d10_macro_summary(spark, sf):
    return marts.macro_summary(_mer(spark, sf), days=7)


@query
def d10_daily_breakdown(spark, sf):
    return marts.daily_breakdown(_mer(spark, sf), days=7)


@query
def d11_channel_rollup(spark, sf):
    return marts.channel_rollup(marts.channel_pnl(*_store(spark, sf)))


# -- workspace KPIs ------------------------------------------------------------


@query
def d12_overview(spark, sf):
    return kpis.overview_metrics(_overview(spark, sf))


@query
def d12_overview_by_workspace(spark, sf):
    by = ("workspace_id",)
    return kpis.overview_metrics(kpis.overview(*_half_year(spark, sf), as_of=b.AS_OF, by=by), by=by)


@query
def d13_trailing_deltas(spark, sf):
    return kpis.trailing_deltas(_overview(spark, sf))


@query
def d14_trend60(spark, sf):
    return kpis.daily_trend(*_half_year(spark, sf), as_of=b.AS_OF)


@query
def d15_channel_breakdown(spark, sf):
    return kpis.channel_breakdown(*_half_year(spark, sf))


@query
def d16_cohort_matrix(spark, sf):
    return customers.cohort_columns(_matrix(spark, sf))


@query
def d17_rfm_segments(spark, sf):
    return customers.segment_summary(_segmented(spark, sf))


@query
def d18_customer_kpis(spark, sf):
    return customers.customer_kpis(_segmented(spark, sf))


@query
def d19_spend_mix(spark, sf):
    return kpis.spend_mix(kpis.channel_breakdown(*_half_year(spark, sf)))


@query
def d20_window_profit(spark, sf):
    return kpis.window_profit(*_half_year(spark, sf), as_of=b.MID_MONTH)


@query
def d21_customer_rollup(spark, sf):
    return customers.customer_rollup(b.half_year_orders(spark, sf))


# -- top-k ----------------------------------------------------------------------


@query
def f1_ordered_marts(spark, sf):
    """Every row of every mart at its place in the mart's order, ties by key."""
    frames = warehouse.mart_frames(b.store_orders(spark, sf), b.store_ad_spend(spark, sf))
    frames["channel_rollup"] = marts.channel_rollup(frames["fct_channel_attributed_pnl"])
    return warehouse.ordered_marts(frames)


@query
def d6_approximate_customers(spark, sf):
    """Customers of each year from stored day sketches, checked against the exact count."""
    path = work_dir(spark, "sketches")
    o = _store(spark, sf)[0]
    sketches.daily_sketches(o).write.parquet(path)
    year = lambda day: F.year(day).alias("year")
    told = sketches.approximate_customers(spark.read.parquet(path), period=year(F.col("date")))
    exact = staging.completed_only(o).groupBy(year(F.col("order_date"))).agg(F.count_distinct("customer_id").alias("exact"))
    near = F.abs(F.col("customers") - F.col("exact")) <= 4 * sketches.ERROR * F.col("exact") + 1
    return told.join(exact, "year").select("year", "orders", F.col("exact").alias("customers"), near.alias("within_four_errors"))


@query
def f2_top_customers(spark, sf):
    return customers.top_customers(_segmented(spark, sf)).drop("recency_days")


@query
def f4_latest_per_key(spark, sf):
    log = b.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return logs.latest_per_key(log, "user_id", "ts", 8, tie=["event_id"])


@query
def f5_best_worst_channel(spark, sf):
    row = insights.best_and_worst_channel(kpis.channel_breakdown(*_half_year(spark, sf)))
    return row.select(
        F.col("best.channel").alias("best_channel"),
        F.col("best.roas").alias("best_roas"),
        F.col("worst.channel").alias("worst_channel"),
        F.col("worst.roas").alias("worst_roas"),
    )


@query
def f6_latest_returning_cohort(spark, sf):
    return customers.latest_returning_cohort(_matrix(spark, sf))


@query
def f7_latest_cohorts(spark, sf):
    return customers.cohort_columns(customers.latest_cohorts(_matrix(spark, sf), 6))


# -- detection and reports --------------------------------------------------------


@query
def g1_cac_surge(spark, sf):
    return detect.cac_surge(_half_year_daily(spark, sf))


@query
def g1_cac_surge_alerts(spark, sf):
    return detect.cac_surge_alerts(detect.cac_surge(_half_year_daily(spark, sf)))


@query
def g2_loss_alerts(spark, sf):
    return detect.loss_alerts(marts.daily_unit_economics(*_store(spark, sf)))


@query
def g1_g2_latest_alerts(spark, sf):
    """A last day on which spend was fifty times as high: both alerts fire."""
    o, a = _half_year(spark, sf)
    last = F.col("date") >= F.lit("2025-06-30").cast("timestamp")
    spend = F.when(last, F.col("spend") * 50).otherwise(F.col("spend")).cast("decimal(12,2)")
    daily = marts.daily_unit_economics(
        staging.stage_orders(o, completed="paid"), staging.stage_ad_spend(a.withColumn("spend", spend)), completed="paid"
    )
    return detect.scan_alerts(daily)


@query
def d14_trend60_by_workspace(spark, sf):
    return kpis.daily_trend(*_half_year(spark, sf), as_of=b.AS_OF, by=("workspace_id",), tenants=_tenants(spark))


@query
def d15_channel_breakdown_by_workspace(spark, sf):
    return kpis.channel_breakdown(*_half_year(spark, sf), by=("workspace_id",), tenants=_tenants(spark))


@query
def g3_channel_insight(spark, sf):
    return insights.channel_insight(kpis.channel_breakdown(*_half_year(spark, sf)))


@query
def g4_profit_insight(spark, sf):
    return insights.profit_insight(kpis.window_profit(*_half_year(spark, sf), as_of=b.MID_MONTH))


@query
def g5_repeat_insight(spark, sf):
    return insights.repeat_insight(_matrix(spark, sf))


@query
def g6_cac_insight(spark, sf):
    return insights.cac_insight(_overview(spark, sf))


@query
def g3_g6_insights(spark, sf):
    return insights.insights_of(*_half_year(spark, sf), as_of=b.AS_OF, profit_as_of=b.MID_MONTH)


@query
def g7_briefing(spark, sf):
    return insights.morning_briefing(_mer(spark, sf))


@query
def g8_scorecard(spark, sf):
    return insights.scorecard(_overview(spark, sf))


# -- scalar functions ----------------------------------------------------------------


@query
def h7_attribution(spark, sf):
    out = attribution.attribute_orders(b.landing_orders(spark, sf))
    return out.select("order_id", "channel", "attribution_tier", "confidence_score", "click_id")


@query
def h7_attribution_strict(spark, sf):
    out = attribution.attribute_orders(b.landing_orders(spark, sf), strict=True, preserve_case=True)
    return out.select("order_id", "channel", "attribution_tier", "confidence_score", "click_id")


@query
def h9_fx(spark, sf):
    o = b.foreign_orders(spark, sf)
    return o.select(
        "order_id",
        to_base(F.col("gross_revenue"), F.col("currency")).alias("gross_usd"),
    )


@query
def c9_fx_table(spark, sf):
    rates = spark.createDataFrame(list(FX_RATES.items()), "code string, rate string")
    out = convert_with_table(
        b.foreign_orders(spark, sf), rates, amount="gross_revenue", currency="currency", out="gross_usd"
    )
    return out.select("order_id", "gross_usd")


@query
def h10_pseudonym(spark, sf):
    o = b.store_orders(spark, sf)
    return o.select("order_id", pseudonym(F.col("customer_id"), b.SALT).alias("customer_token"))


@query
def h18_segments(spark, sf):
    return _segmented(spark, sf).select("customer_id", "recency_days", "segment", "segment_label")


@query
def h22_report_text(spark, sf):
    o = b.store_orders(spark, sf)
    share = F.col("gross_revenue") * F.lit("0.0001").cast("decimal(5,4)")
    return o.select(
        "order_id",
        text.currency_text(F.col("gross_revenue")).alias("money"),
        text.currency_text(-share).alias("small_money"),
        text.currency_text(F.col("gross_revenue") * 10, compact=True).alias("compact_money"),
        text.number_text(F.col("order_id").cast("long")).alias("number"),
        text.percent_text(share).alias("percent"),
        text.multiplier_text(share).alias("multiplier"),
        text.month_label(F.col("order_date")).alias("month"),
        text.day_label(F.col("order_date")).alias("day"),
    )


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# -- streaming ---------------------------------------------------------------------


def _orders_feed(spark, sf, **changes: Column) -> DataFrame:
    """Store orders as a feed, some columns changed."""
    o = b.store_orders(spark, sf).drop("workspace_id")
    return o.withColumns({**changes, "_seq": F.col("order_id").cast("long")})


def _ingest_waves(spark, root: str, waves: list[DataFrame], fold: bool = True) -> None:
    """Land each wave as many files and run the stream once after it: a batch a wave."""
    for rows in waves:
        rows.write.mode("append").parquet(f"{root}/in")
        feed = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        ingest.ingest_orders(feed, root, f"{root}/checkpoint").awaitTermination()
        if fold:
            changelog.compact(spark, root)


@query
def i1_stream_ingest(spark, sf):
    """Five waves: all orders, some unreadable; then a fifth of them four times with other prices and statuses."""
    root = work_dir(spark, "orders-log")
    o, key = b.table(spark, sf, "orders"), F.col("o_orderkey")

    def rows(again: int) -> DataFrame:
        price = (F.col("o_totalprice").cast("decimal(12,2)") + again).cast("decimal(12,2)")
        return o.where(key % 5 == 0 if again else F.lit(True)).select(
            key.cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
            F.when(key % 101 == 0, "ten").otherwise(price.cast("string")).alias("gross_revenue"),
            F.lit("Refunded" if again else "Completed").alias("status"),
            key.alias("_seq"),
        )

    _ingest_waves(spark, root, [rows(k) for k in (0, 4, 3, 2, 1)])
    return changelog.current_orders(spark, root).drop("created_at", "landing_site")


@query
def i2_live_daily(spark, sf):
    """Orders and spend year by year; some orders of the first years come years late and are left out."""
    path = work_dir(spark, "live-daily")
    o = b.store_orders(spark, sf).drop("workspace_id")
    a = b.store_ad_spend(spark, sf).select(F.col("date").cast("timestamp").alias("date"), "spend")
    year = F.year("order_date")
    late = (F.col("order_id").cast("long") % 7 == 0) & (year < b.LATE_BEFORE)
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{path}/{name}")
    for first, last in b.YEARS:
        o.where(year.between(first, last) & ~late).write.mode("append").parquet(f"{path}/orders")
        if (first, last) == b.YEARS[-1]:
            o.where(late).write.mode("append").parquet(f"{path}/orders")
        a.where(F.year("date").between(first, last)).write.mode("append").parquet(f"{path}/ads")
        flows = live.daily_flows(read("orders", o.schema), read("ads", a.schema), delay="3 days")
        live.save_updates(flows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    updates = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*")
    return live.economics_of(live.latest_days(updates))


@query
def i2_status_change(spark, sf):
    """Every other order is pending in a first wave and gets its status in a second: sums follow the log."""
    root = work_dir(spark, "status-change")
    odd = F.col("order_id").cast("long") % 2 == 1
    first = _orders_feed(spark, sf, status=F.when(odd, "Pending").otherwise(F.col("status")))
    _ingest_waves(spark, root, [first, _orders_feed(spark, sf).where(odd)])
    return live.corrected_days(spark, root, b.store_ad_spend(spark, sf))


@query
def i2_corrected_days(spark, sf):
    """Three waves: all orders completed and a fifth too dear, then refunds, then the right prices; sums after each."""
    root = work_dir(spark, "corrected-days")
    fifth = F.col("order_id").cast("long") % 5 == 0
    dear = F.when(fifth, F.col("gross_revenue") + 7).otherwise(F.col("gross_revenue")).cast("decimal(12,2)")
    done = F.lit("Completed")
    waves = [
        _orders_feed(spark, sf, gross_revenue=dear, status=done),
        _orders_feed(spark, sf, gross_revenue=dear).where(F.col("status") == "Refunded"),
        _orders_feed(spark, sf).where(fifth),
    ]
    for rows in waves:
        _ingest_waves(spark, root, [rows])
        days = live.corrected_days(spark, root, b.store_ad_spend(spark, sf))
    return days


@query
def i3_payments(spark, sf):
    events = billing.parse_events(b.billing_events(spark, sf))
    return billing.payments(events).drop("received_at")


@query
def i3_current_plans(spark, sf):
    events = billing.parse_events(b.billing_events(spark, sf))
    return billing.current_plans(events).select("user_id", "plan")


@query
def i3_stream_plans(spark, sf):
    """Billing events landed by a stream, then folded."""
    root = work_dir(spark, "billing")
    b.billing_events(spark, sf).repartition(3).write.parquet(f"{root}/in")
    schema = "seq bigint, received_at timestamp, body string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    billing.land_events(billing.parse_events(stream), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return billing.current_plans(spark.read.parquet(f"{root}/log")).select("user_id", "plan")


@query
def i3_state_plans(spark, sf):
    """Billing events in three waves, folded into the state of customers and users."""
    root = work_dir(spark, "billing-state")
    events = b.billing_events(spark, sf)
    cuts = events.agg(F.percentile("seq", F.array(F.lit(0.33), F.lit(0.66))).alias("c")).first()["c"]
    for low, high in zip([-1, *cuts], [*cuts, float("inf")], strict=True):
        events.where((F.col("seq") > low) & (F.col("seq") <= high)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        billing.keep_plans(billing.parse_events(stream), root, f"{root}/checkpoint").awaitTermination()
    return billing.kept_plans(spark, root).select("user_id", "plan")


@query
def i3_activity(spark, sf):
    return billing.activity(billing.parse_events(b.billing_events(spark, sf)))


def _throttled(spark, sf, limit, window):
    events = b.table(spark, sf, "events")
    return throttle.audit(events, work_dir(spark, "throttle"), key="user_id", at="ts", limit=limit, window=window)


@query
def i4_throttle_audit(spark, sf):
    return _throttled(spark, sf, limit=10, window=600)


@query
def i4_throttle_hourly(spark, sf):
    return _throttled(spark, sf, limit=3, window=3600)


@query
def i4_throttle_long(spark, sf):
    """Windows of five days: chains of windows with many events each."""
    return _throttled(spark, sf, limit=10, window=5 * 86_400)


@query
def i4_stream(spark, sf):
    """The audit as a stream over two files, each in order, and a last event that closes all windows."""
    root = work_dir(spark, "throttle-stream")
    events = b.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    middle = ends["low"] + (ends["high"] - ends["low"]) / 2
    clock = spark.createDataFrame([("clock", ends["high"] + dt.timedelta(days=30))], "user_id string, ts timestamp")
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", STATE_STORE):
        for rows in (events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle), clock):
            rows.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
            found = throttle_live.audit_stream(stream, key="user_id", at="ts", limit=10, window=600, delay="10 minutes")
            throttle_live.save_windows(found, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


# -- promised analyses --------------------------------------------------------------


@query
def x1_zscore(spark, sf):
    o, a = _half_year(spark, sf)
    staged = staging.stage_orders(o, completed="paid")
    refunds = detect.daily_refund_rate(staged, refunded="refunded")
    return detect.daily_z_scores(_half_year_daily(spark, sf), refunds)


@query
def x2_roas_decay(spark, sf):
    return detect.roas_decay(marts.channel_pnl(*_store(spark, sf)))


@query
def x3_return_spikes(spark, sf):
    return skus.sku_return_spikes(b.order_lines(spark, sf))


@query
def x4_sku_margin(spark, sf):
    return skus.sku_margins(b.order_lines(spark, sf), b.store_orders(spark, sf))


@query
def x5_stock_runway(spark, sf):
    return skus.stock_runway(
        b.order_lines(spark, sf), b.stock(spark, sf), as_of="2001-06-30", days=30
    )


@query
def x6_repurchase_30_60_90(spark, sf):
    return customers.repurchase_windows(_store(spark, sf)[0])


@query
def x7_tier_revenue_share(spark, sf):
    o = staging.stage_orders(b.half_year_orders(spark, sf), completed="paid")
    return customers.tier_revenue_share(customers.customer_ltv(o, completed="paid"))


@query
def x8_full_briefing(spark, sf):
    o, a = _store(spark, sf)
    # One day is reported: as a literal it keeps other days from being read.
    day = F.lit(insights.latest_active_day(o)).cast("date")
    o, a = o.where(F.col("order_date") == day), a.where(F.col("ad_date") == day)
    daily = marts.marketing_efficiency(marts.daily_unit_economics(o, a))
    sellers = skus.best_sellers(b.order_lines(spark, sf).where(F.col("line_date") == day))
    return insights.full_briefing(daily, marts.channel_pnl(o, a), sellers, one_day=True)


@query
def x9_claimed_vs_resolved(spark, sf):
    ads = staging.stage_ad_spend(b.store_ad_spend(spark, sf))
    return attribution.claimed_vs_resolved(b.landing_orders(spark, sf), ads)


@query
def x9_resolved_channel_pnl(spark, sf):
    landed = attribution.attribute_orders(b.landing_orders(spark, sf))
    o = staging.stage_orders(landed.withColumn("acquisition_channel", F.col("channel")))
    return marts.channel_pnl(o, staging.stage_ad_spend(b.store_ad_spend(spark, sf)))


@query
def x10_hashed_ids(spark, sf):
    people = b.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("market"),
    )
    return hash_identifiers(people, ["customer_id", "name"], b.SALT)
