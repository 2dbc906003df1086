"""The registered queries in plain SQL, as an independent check.

Labels, channel names, segment names and report sentences are fixed values: they
must equal what the operators return.

Decimal quotients go through ``decimal(28,8)`` before rounding, because the SQL
engine used for checking divides decimals as doubles.
"""

from __future__ import annotations

# -- expression helpers ----------------------------------------------------------


def ratio(a: str, b: str, scale: int = 2) -> str:
    return f"round(cast(({a}) / nullif({b}, 0) as decimal(28,8)), {scale})"


def ratio0(a: str, b: str, scale: int = 2) -> str:
    return f"coalesce(case when ({b}) > 0 then {ratio(a, b, scale)} end, 0)"


def pct(a: str, b: str, scale: int = 2) -> str:
    return ratio(f"({a}) * 100", b, scale)


def pct0(a: str, b: str, scale: int = 2) -> str:
    return f"coalesce(case when ({b}) > 0 then {pct(a, b, scale)} end, 0)"


def fratio(a: str, b: str) -> str:
    """Unrounded double quotient, zero unless the denominator is positive."""
    return f"coalesce(case when ({b}) > 0 then cast({a} as double) / cast({b} as double) end, 0)"


def delta(cur: str, prev: str) -> str:
    return (
        f"coalesce(case when ({prev}) > 0 then (cast({cur} as double) - cast({prev} as double))"
        f" / cast({prev} as double) * 100.0 end, 0)"
    )


def dbl(expr: str, name: str | None = None) -> str:
    return f"cast({expr} as double) as {name or expr}"


def big(expr: str, name: str | None = None) -> str:
    return f"cast({expr} as bigint) as {name or expr}"


def day(expr: str, name: str | None = None) -> str:
    return f"strftime(cast({expr} as date), '%Y-%m-%d') as {name or expr}"


def stamp(expr: str, name: str | None = None) -> str:
    return f"strftime(cast({expr} as timestamp), '%Y-%m-%d %H:%M:%S') as {name or expr}"


def fixed(x: str, digits: int) -> str:
    return (
        f"cast(cast(round(cast({x} as decimal(28,8)), {digits}) as decimal(28,{digits})) as varchar)"
    )


def grouped(x: str, digits: int = 0) -> str:
    """Thousands separators on the whole part of a non-negative value."""
    rounded = f"cast(round(cast({x} as decimal(28,8)), {digits}) as decimal(28,{digits}))"
    whole = f"format('{{:,}}', cast(trunc({rounded}) as bigint))"
    if digits == 0:
        return whole
    return f"({whole} || '.' || right(cast({rounded} as varchar), {digits}))"


def currency(x: str, compact: bool = False) -> str:
    size = f"abs(cast({x} as decimal(28,8)))"
    body = f"case when {size} < 100 then {grouped(size, 2)} else {grouped(size, 0)} end"
    if compact:
        body = (
            f"case when {size} >= 1000000 then {fixed(f'cast({size} * 0.000001 as decimal(28,10))', 2)} || 'M'"
            f" when {size} >= 1000 then {fixed(f'cast({size} * 0.001 as decimal(28,10))', 1)} || 'k' else {body} end"
        )
    return f"(case when {x} < 0 then '-' else '' end || '$' || ({body}))"


# -- inputs ------------------------------------------------------------------------

_CHANNEL = """case o_orderpriority when '1-URGENT' then 'Meta Ads' when '2-HIGH' then 'Google Ads'
    when '3-MEDIUM' then 'TikTok Ads' when '5-LOW' then 'Organic / Direct' end"""
_GROSS = "cast(o_totalprice as decimal(12,2))"
_C35 = "cast(0.35 as decimal(3,2))"

RAW = f"""raw as (
  select 'ws' || cast(o_custkey % 4 as varchar) as workspace_id,
    o_orderkey as k, cast(o_orderkey as varchar) as order_id, cast(o_custkey as varchar) as customer_id,
    cast(o_orderdate as timestamp) as order_date, {_GROSS} as gross_revenue,
    cast(round({_GROSS} * {_C35}, 2) as decimal(12,2)) as cogs,
    cast(5 as decimal(10,2)) as shipping_cost, {_CHANNEL} as acquisition_channel,
    case when o_orderstatus = 'P' then 'Refunded' else 'Completed' end as status
  from orders)"""

STORE = RAW + """, o as (
  select workspace_id, k, order_id, customer_id, order_date as order_timestamp, cast(order_date as date) as order_date,
    cast(gross_revenue as decimal(10,2)) as gross_revenue, cast(cogs as decimal(10,2)) as cogs, shipping_cost,
    acquisition_channel, status, case when status = 'Completed' then 1 else 0 end as is_completed_order,
    case when status = 'Completed' then gross_revenue - cogs - shipping_cost else 0 end as net_margin
  from raw)"""

ADS = """a as (
  select 'ws' || cast(l_suppkey % 4 as varchar) as workspace_id, cast(l_shipdate as date) as ad_date,
    case l_returnflag when 'A' then 'Meta Ads' when 'R' then 'Google Ads' when 'N' then 'TikTok Ads' end as channel,
    cast(l_suppkey as varchar) as campaign_id,
    cast(round(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)), 2) as decimal(10,2)) as ad_spend,
    cast(l_quantity as bigint) as clicks, cast(l_quantity * 100 as bigint) as impressions
  from lineitem)"""

_HGROSS = "cast(round(cast(o_totalprice as decimal(12,2)) * cast(0.001 as decimal(4,3)), 2) as decimal(12,2))"
HALF = f"""h as (
  select 'ws' || cast(o_custkey % 4 as varchar) as workspace_id, cast(o_orderkey as varchar) as order_id,
    cast(o_custkey as varchar) || '-' || cast(o_orderkey % 8 as varchar) as customer_id,
    cast(date '2025-01-01' + cast(o_orderkey * 7 % 181 as integer) as timestamp) as order_date,
    {_HGROSS} as gross_revenue, cast(round({_HGROSS} * {_C35}, 2) as decimal(12,2)) as cogs,
    cast(5 as decimal(10,2)) as shipping_cost,
    case o_orderpriority when '1-URGENT' then 'Meta' when '2-HIGH' then 'Google'
      when '3-MEDIUM' then 'TikTok' when '5-LOW' then 'Organic' end as acquisition_channel,
    case when o_orderstatus = 'P' then 'refunded' else 'paid' end as status
  from orders),
ha as (
  select 'ws' || cast(l_suppkey % 4 as varchar) as workspace_id,
    cast(date '2025-01-01' + cast(l_orderkey % 181 as integer) as timestamp) as date,
    case l_returnflag when 'A' then 'Meta' when 'R' then 'Google' when 'N' then 'TikTok' end as channel,
    cast(round(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) * cast(0.01 as decimal(3,2)), 2) as decimal(12,2)) as spend,
    cast(l_quantity * 100 as bigint) as impressions, cast(l_quantity as bigint) as clicks,
    cast(l_linenumber as bigint) as conversions
  from lineitem)"""

AS_OF = "timestamp '2025-07-01 00:00:00'"
MID = "timestamp '2025-06-20 12:00:00'"

LANDED = RAW + """, landed as (
  select *,
    case k % 10 when 0 then 'https://shop.example/p?fbclid=IwAR' || order_id
      when 1 then 'https://shop.example/p?utm_medium=cpc&gclid=Cj_' || order_id
      when 2 then 'https://shop.example/p?wbraid=Zz9'
      when 3 then 'https://shop.example/p?ttclid=T-' || order_id
      when 9 then null else 'https://shop.example/p' end as url,
    case k % 10 when 4 then 'Instagram' when 5 then 'youtube' when 6 then 'klaviyo' when 7 then 'campaign_x'
      when 8 then 'tiktok_ads' when 9 then null else '' end as src,
    case when k % 13 = 0 then 'FBA,priority' when k % 17 = 0 then null else 'retail' end as tags
  from raw),
low as (select *, lower(coalesce(url, '')) as u, lower(coalesce(src, '')) as s, lower(coalesce(tags, '')) as t from landed),
rule as (
  select *, case
    when t like '%amazon%' or t like '%fba%' or s like '%amz%' then 1
    when u like '%fbclid=%' then 2
    when u like '%gclid=%' or u like '%wbraid=%' or u like '%gbraid=%' then 3
    when u like '%ttclid=%' then 4
    when s like '%facebook%' or s like '%fb%' or s like '%instagram%' or s like '%ig%' then 5
    when s like '%google%' or s like '%pmax%' or s like '%youtube%' then 6
    when s like '%tiktok%' then 7
    when s like '%klaviyo%' or s like '%email%' then 8 else 9 end as r,
   case
    when t like '%amazon%' or t like '%fba%' or s like '%amz%' then 1
    when u like '%fbclid=%' then 2
    when u like '%gclid=%' or u like '%wbraid=%' or u like '%gbraid=%' then 3
    when u like '%ttclid=%' then 4
    when regexp_matches(s, '(^|[^a-z0-9])(facebook|fb|instagram|ig)([^a-z0-9]|$)') then 5
    when regexp_matches(s, '(^|[^a-z0-9])(google|pmax|youtube)([^a-z0-9]|$)') then 6
    when regexp_matches(s, '(^|[^a-z0-9])tiktok([^a-z0-9]|$)') then 7
    when regexp_matches(s, '(^|[^a-z0-9])(klaviyo|email)([^a-z0-9]|$)') then 8 else 9 end as strict_r
  from low)"""

LINES = """li as (
  select cast(l_orderkey as varchar) as order_id, cast(l_partkey as varchar) as sku, cast(l_shipdate as date) as line_date,
    cast(l_quantity as bigint) as units, cast(l_extendedprice as decimal(12,2)) as revenue,
    cast(round(cast(l_extendedprice as decimal(12,2)) * cast(0.35 as decimal(3,2)), 2) as decimal(12,2)) as goods,
    l_returnflag = 'R' as returned
  from lineitem)"""


def resolved(r: str = "r") -> str:
    return (
        f"case {r} when 1 then 'Amazon Marketplace' when 2 then 'Meta Ads' when 5 then 'Meta Ads'"
        f" when 3 then 'Google Ads' when 6 then 'Google Ads' when 4 then 'TikTok Ads' when 7 then 'TikTok Ads'"
        f" else 'Organic, Direct & Klaviyo Email' end"
    )


def verdict(r: str, text: str) -> str:
    """Columns of one attribution verdict."""
    ids = " ".join(
        f"when {n} then nullif(regexp_extract({text}, '{p}=([a-zA-Z0-9_-]+)', 1), '')"
        for n, p in ((2, "fbclid"), (3, "gclid"), (4, "ttclid"))
    )
    return f"""order_id, {resolved(r)} as channel,
  case when {r} = 1 then 'TIER_3_MARKETPLACE' when {r} <= 4 then 'TIER_1_CLICK_ID' when {r} <= 7 then 'TIER_2_UTM'
    when {r} = 8 then 'TIER_2_UTM_RETENTION' else 'TIER_4_DIRECT_ORGANIC' end as attribution_tier,
  cast(case when {r} = 1 then 1.0 when {r} <= 4 then 0.95 when {r} <= 7 then 0.8 when {r} = 8 then 0.9 else 0.7 end as double) as confidence_score,
  case {r} {ids} end as click_id"""


# -- marts ---------------------------------------------------------------------------


def daily(orders: str, ads: str, good: str, key: str = "", spend: str = "ad_spend", ad_day: str = "ad_date") -> str:
    """Daily unit economics as a CTE named ``d``."""
    on = f" and x.{key} = y.{key}" if key else ""
    k = f"{key}, " if key else ""
    kk = f"coalesce(x.{key}, y.{key}) as {key}, " if key else ""
    return f"""x as (
  select {k}cast(order_date as date) as date, count(distinct order_id) as n, count(distinct customer_id) as buyers,
    sum(gross_revenue) as rev, sum(cogs) as cogs, sum(shipping_cost) as ship, sum(gross_revenue - cogs - shipping_cost) as margin
  from {orders} where status = '{good}' group by all),
y as (select {k}cast({ad_day} as date) as date, sum({spend}) as spend, sum(clicks) as clicks, sum(impressions) as imp from {ads} group by all),
j as (
  select {kk}coalesce(x.date, y.date) as date, coalesce(n, 0) as n, coalesce(rev, 0) as rev, coalesce(spend, 0) as spend,
    coalesce(margin, 0) - coalesce(spend, 0) as profit, coalesce(buyers, 0) as buyers, coalesce(cogs, 0) as cogs,
    coalesce(ship, 0) as ship, coalesce(clicks, 0) as clicks, coalesce(imp, 0) as imp
  from x full outer join y on x.date = y.date{on}),
d as (select *, {ratio0('spend', 'n')} as cac, {ratio0('rev', 'spend')} as roas from j)"""


_DAILY_COLS = ", ".join(
    [
        day("date"),
        big("n", "total_orders"),
        dbl("rev", "total_revenue"),
        dbl("spend", "total_ad_spend"),
        dbl("profit", "net_profit"),
        dbl("cac", "blended_cac"),
        dbl("roas", "blended_roas"),
    ]
)
_STORE_DAILY = f"with {STORE}, {ADS}, {daily('o', 'a', 'Completed')}"
_HALF_DAILY = f"with {HALF}, {daily('h', 'ha', 'paid', spend='spend', ad_day='date')}"

D1 = f"{_STORE_DAILY} select {_DAILY_COLS} from d"


def pnl(orders: str = "o", channel: str = "coalesce(acquisition_channel, 'Organic / Direct')") -> str:
    """Channel P&L as a CTE named ``p``."""
    return f"""x as (
  select order_date as date, {channel} as channel, count(distinct order_id) as n, sum(gross_revenue) as rev,
    sum(cogs) as cogs, sum(shipping_cost) as ship, sum(gross_revenue - cogs - shipping_cost) as gp
  from {orders} where status = 'Completed' group by all),
y as (select ad_date as date, channel, sum(ad_spend) as spend from a group by all),
p as (
  select coalesce(x.date, y.date) as date, coalesce(x.channel, y.channel) as channel, coalesce(n, 0) as n,
    coalesce(rev, 0) as rev, coalesce(spend, 0) as spend, coalesce(cogs, 0) as cogs, coalesce(ship, 0) as ship,
    coalesce(gp, 0) - coalesce(spend, 0) as profit
  from x full outer join y on x.date = y.date and x.channel = y.channel)"""


_PNL_COLS = ", ".join(
    [
        day("date"),
        "channel",
        big("n", "total_orders"),
        dbl("rev", "attributed_revenue"),
        dbl("spend", "channel_ad_spend"),
        dbl("cogs", "attributed_cogs"),
        dbl("ship", "attributed_shipping"),
        dbl("profit", "channel_net_profit"),
        dbl(ratio0("rev", "spend"), "channel_roas"),
        dbl(f"case when spend > 0 and n > 0 then {ratio('spend', 'n')} else 0 end", "channel_cac"),
    ]
)
_STORE_PNL = f"with {STORE}, {ADS}, {pnl()}"

D3 = f"""with {STORE}, g as (
  select acquisition_channel, count(distinct order_id) as placed,
    sum(case when status = 'Completed' then 1 else 0 end) as done, sum(case when status = 'Refunded' then 1 else 0 end) as refunded,
    sum(gross_revenue) as gross, sum(cogs) as cogs, sum(shipping_cost) as ship,
    sum(case when status = 'Completed' then gross_revenue - cogs - shipping_cost else -(cogs + shipping_cost) end) as profit
  from o group by 1)
select acquisition_channel, {big('placed', 'total_orders_placed')}, {big('done', 'completed_orders')}, {big('refunded', 'refunded_orders')},
  {dbl(pct('refunded', 'placed'), 'refund_rate_pct')}, {dbl('gross', 'gross_revenue_volume')}, {dbl('cogs', 'total_cogs')},
  {dbl('ship', 'total_shipping')}, {dbl('profit', 'total_net_profit')}, {dbl(pct('profit', 'gross'), 'net_profit_margin_pct')}
from g"""

D5 = f"""with {STORE}, g as (
  select acquisition_channel, count(distinct order_id) as n, count(distinct order_date) as days, sum(gross_revenue) as rev
  from o where status = 'Completed' group by 1),
v as (select *, {ratio('n', 'days')} as speed from g)
select acquisition_channel, {big('n', 'total_units_sold')}, {dbl('speed', 'daily_burn_velocity')}, {dbl('rev', 'total_channel_revenue')},
  case when speed > 15 then 'High Velocity (Scale Ad Budget)' when speed > 5 then 'Moderate Velocity'
    else 'Low Velocity (Needs Creative Refresh)' end as operational_status
from v"""

_LTV = """l as (
  select customer_id, min(order_date) as first_d, max(order_date) as last_d, count(distinct order_id) as n,
    sum(gross_revenue) as rev, sum(gross_revenue - cogs - shipping_cost) as margin
  from {src} where status = '{good}' group by 1),
lt as (select *, case when n >= 4 then 'Champion (VIP)' when n >= 2 then 'Loyal Customer' else 'One-Time Buyer' end as tier from l)"""

_COHORT = """dated as (
  select customer_id, gross_revenue, net_margin, date_trunc('month', order_date) as month,
    date_trunc('month', min(order_date) over (partition by customer_id)) as cohort
  from o where status = 'Completed'),
c as (
  select cohort, datediff('month', cohort, month) as m, count(distinct customer_id) as n,
    sum(gross_revenue) as rev, sum(net_margin) as profit, max(members) as size
  from dated join (select cohort as born, count(distinct customer_id) as members from dated group by 1) on born = cohort
  group by 1, 2)"""

_MER = f"""{_STORE_DAILY}, mer as (select *, {pct0('profit', 'rev')} as margin_pct from d)"""
_MER_COLS = ", ".join(
    [
        day("date"),
        big("n", "total_orders"),
        dbl("rev", "gross_revenue"),
        dbl("spend", "total_ad_spend"),
        dbl("profit", "net_cash_profit"),
        dbl("roas", "marketing_efficiency_ratio"),
        dbl("cac", "blended_cac"),
        dbl("margin_pct", "net_profit_margin_pct"),
    ]
)

# -- workspace KPIs --------------------------------------------------------------------


def overview(key: str = "") -> str:
    k = f"{key}, " if key else ""
    kk = f"coalesce(x.{key}, y.{key}) as {key}, " if key else ""
    on = f"x.{key} = y.{key}" if key else "true"
    group = f"group by {key}" if key else ""
    last = f"order_date >= {AS_OF} - interval 14 day and order_date < {AS_OF}"
    prev = f"order_date >= {AS_OF} - interval 28 day and order_date < {AS_OF} - interval 14 day"
    return f"""with {HALF}, x as (
  select {k}coalesce(sum(gross_revenue), 0) as rev, count(*) as n, coalesce(sum(cogs), 0) as cogs, coalesce(sum(shipping_cost), 0) as ship,
    coalesce(sum(case when {last} then gross_revenue end), 0) as r1, coalesce(sum(case when {prev} then gross_revenue end), 0) as r0,
    count(case when {last} then 1 end) as n1, count(case when {prev} then 1 end) as n0
  from h where status = 'paid' {group}),
y as (
  select {k}coalesce(sum(spend), 0) as spend, coalesce(sum(case when {last.replace('order_date', 'date')} then spend end), 0) as s1,
    coalesce(sum(case when {prev.replace('order_date', 'date')} then spend end), 0) as s0
  from ha {group}),
w as (
  select {kk}coalesce(rev, 0) as rev, coalesce(n, 0) as n, coalesce(cogs, 0) as cogs, coalesce(ship, 0) as ship,
    coalesce(spend, 0) as spend, r1, r0, n1, n0, s1, s0
  from x full outer join y on {on}),
v as (
  select *, rev - cogs - ship as gross, rev - cogs - ship - spend as cm1,
    rev - cogs - ship - spend - rev * cast(0.1 as decimal(2,1)) as cm2,
    {fratio('r1', 's1')} as roas1, {fratio('r0', 's0')} as roas0, {fratio('s1', 'n1')} as cac1, {fratio('s0', 'n0')} as cac0,
    {fratio('rev', 'spend')} as roas, {fratio('spend', 'n')} as cac
  from w)"""


_OVERVIEW_COLS = ", ".join(
    [
        dbl("rev", "revenue"),
        big("n", "orders"),
        dbl("spend", "ad_spend"),
        "roas",
        "cac",
        dbl("gross", "gross_profit"),
        dbl("cm1"),
        dbl("cm2"),
        f"{fratio('cm2', 'rev')} * 100.0 as net_margin",
        f"{fratio('rev', 'n')} as aov",
        dbl("cogs", "total_cogs"),
        dbl("ship", "total_shipping"),
    ]
)
_DELTA_COLS = ", ".join(
    [
        f"{delta('r1', 'r0')} as revenue_delta",
        f"{delta('n1', 'n0')} as orders_delta",
        f"{delta('s1', 's0')} as spend_delta",
        f"{delta('roas1', 'roas0')} as roas_delta",
        f"{delta('cac1', 'cac0')} as cac_delta",
    ]
)

_BREAKDOWN = f"""with {HALF},
ch as (select * from (values ('Meta', 0), ('Google', 1), ('TikTok', 2)) t(channel, position)),
x as (select acquisition_channel as channel, sum(gross_revenue) as rev, count(*) as n from h where status = 'paid' group by 1),
y as (select channel, sum(spend) as spend, sum(impressions) as imp, sum(clicks) as clicks, sum(conversions) as conv from ha group by 1),
br as (
  select ch.channel, position, coalesce(spend, 0) as spend, coalesce(rev, 0) as rev, coalesce(n, 0) as n, coalesce(conv, 0) as conv,
    coalesce(imp, 0) as imp, coalesce(clicks, 0) as clicks
  from ch left join x on ch.channel = x.channel left join y on ch.channel = y.channel),
bk as (select *, {fratio('rev', 'spend')} as roas, {fratio('spend', 'n')} as cac from br)"""

_CUSTOMERS = """cu as (
  select customer_id, min(order_date) as first_at, max(order_date) as last_at, count(case when status = 'paid' then 1 end) as n,
    round(coalesce(sum(case when status = 'paid' then gross_revenue end), 0), 2) as spend
  from h group by 1)"""
_SEGMENTED = f"""{_CUSTOMERS},
sg as (
  select *, case when spend >= 400 or n >= 4 then 'vip' when rec > 120 then 'lost' when rec > 60 then 'at_risk'
      when n = 1 and rec <= 30 then 'new' when n >= 2 then 'loyal' when spend >= 150 then 'promising' else 'active' end as segment
  from (select *, date_diff('day', last_at, {AS_OF}) as rec from cu) z),
lab as (select * from (values ('vip', 'VIP', 1), ('loyal', 'Loyal', 2), ('promising', 'Promising', 3), ('new', 'New', 4),
  ('at_risk', 'At risk', 5), ('lost', 'Lost', 6), ('active', 'Active', 7)) t(segment, label, position))"""

_MATRIX = f"""with {HALF}, {_CUSTOMERS},
om as (select distinct customer_id, year(order_date) * 12 + month(order_date) as mi from h where status = 'paid'),
cm as (select customer_id, cast(date_trunc('month', first_at) as date) as cohort from cu),
mx as (
  select cohort, count(distinct cm.customer_id) as size,
    {', '.join(f"count(distinct case when mi = year(cohort) * 12 + month(cohort) + {k} then cm.customer_id end) as c{k}" for k in range(6))}
  from cm left join om on cm.customer_id = om.customer_id group by 1),
mt as (
  select cohort, strftime(cohort, '%b %y') as label, size, {', '.join(f"cast({pct(f'c{k}', 'size', 1)} as double) as m{k}" for k in range(6))}
  from mx)"""
_MATRIX_COLS = f"{day('cohort', 'cohort_month')}, label, {big('size')}, m0, m1, m2, m3, m4, m5"

# -- detection ----------------------------------------------------------------------------

_SURGE = f"""{_HALF_DAILY},
act as (select date, n, cac from d where rev > 0),
tr as (
  select *, sum(cac) over w as s, count(cac) over w as prior from act
  window w as (order by date rows between 7 preceding and 1 preceding)),
su as (
  select *, {ratio('s', 'prior')} as mean7, {ratio('(cac * prior - s) * 100', 's', 1)} as change,
    coalesce(prior >= 6 and s > 0 and cac * prior > s * cast(1.20 as decimal(3,2)) and n > 5, false) as surge
  from tr)"""
_SURGE_ALERT = (
    "select {cols}'CRITICAL' as severity, 'Blended CAC surged +' || "
    + fixed("change", 1)
    + " || '% yesterday' as title, 'Audit underperforming ad sets on Meta & TikTok. Trim budget by 20%.' as action"
)
_LOSS_ALERT = (
    "select {cols}'CRITICAL' as severity, 'Negative Net Cash Margin on ' || strftime(date, '%Y-%m-%d') as title,"
    " 'Immediate ad spend capping required to prevent working capital drain.' as action"
)
_DATE_COL = day("date") + ", "


def zscore(source: str, value: str, order: str, part: str = "") -> str:
    """Select list pieces for a z-score over the seven preceding rows."""
    by = f"partition by {part} " if part else ""
    w = f"({by}order by {order} rows between 7 preceding and 1 preceding)"
    v = f"cast({value} as decimal(16,2))"
    return f"""(
  select *, {v} as v, count({value}) over {w} as zn, cast(sum({v}) over {w} as decimal(18,2)) as zs,
    cast(sum({v} * {v}) over {w} as decimal(36,4)) as zq
  from {source})"""


_SPREAD = "cast(zn * zq - zs * zs as double)"
_Z = (
    f"case when zn >= 7 and {_SPREAD} > 0 then (cast(v as double) - cast(zs as double) / cast(zn as double))"
    f" / sqrt({_SPREAD} / (cast(zn as double) * (cast(zn as double) - 1.0))) end"
)


def zmetric(source: str, value: str, metric: str) -> str:
    return (
        f"select {_DATE_COL}'{metric}' as metric, cast(v as double) as value, {_Z} as z_score,"
        f" coalesce(abs({_Z}) >= 3, false) as is_anomaly from {zscore(source, value, 'date')} z"
    )


# -- feeds ---------------------------------------------------------------------------------

_FEED = f"""{RAW}, feed as (
  select k, order_id, customer_id, case when k % 103 = 0 then 'someday' else strftime(order_date, '%Y-%m-%d %H:%M:%S') end as order_date_text,
    case when k % 101 = 0 then 'ten' else cast(gross_revenue as varchar) end as revenue_text,
    order_date, gross_revenue, cogs, acquisition_channel, status
  from raw)"""
_GOOD_TAIL = (
    "cast(0 as double) as taxes, cast(0 as double) as discounts, 'USD' as currency"
)


def _oracle() -> dict[str, str]:
    q: dict[str, str] = {}

    q["a1_ad_spend_csv"] = f"""with {ADS} select {day('ad_date', 'date')}, channel, {big('count(*)', 'n')}, {dbl('sum(ad_spend)', 'spend')},
      {big('sum(clicks)', 'clicks')}, {big('sum(impressions)', 'impressions')} from a where clicks % 50 <> 49 group by ad_date, channel"""
    q["a1_quarantine"] = f"""with {ADS} select 'ad_spend_csv' as source_system, 'spend: not a number: n/a' as error_reason, {big('count(*)', 'n')}
      from a where clicks % 50 = 49 having count(*) > 0"""
    q["a2_orders_export"] = f"""with {_FEED} select order_id, customer_id, {stamp('order_date')}, {dbl('gross_revenue')}, {dbl('cogs')},
      cast(0 as double) as shipping_cost, 'Organic / Direct' as acquisition_channel, 'Completed' as status, {_GOOD_TAIL}
      from feed where k % 101 <> 0 and k % 103 <> 0"""
    q["a3_storefront_orders"] = f"""select cast(o_orderkey as varchar) as order_id,
      'CUST_' || case when o_orderstatus = 'O' then 'GUEST' else cast(o_custkey as varchar) end as customer_id,
      {stamp('o_orderdate', 'order_date')}, {dbl(_GROSS, 'gross_revenue')}, {dbl(f'round({_GROSS} * {_C35}, 2)', 'cogs')},
      cast(case when o_orderpriority = '1-URGENT' then 9.5 else 5 end as double) as shipping_cost,
      case when o_orderpriority = '2-HIGH' then 'pos' else 'Shopify Web' end as acquisition_channel,
      case when o_orderstatus = 'P' then 'Refunded' else 'Completed' end as status from orders where o_orderkey % 89 <> 0 and o_orderkey % 97 <> 0"""
    q["a2_quarantine"] = f"""with {_FEED} select 'orders_export' as source_system, case when k % 53 = 0 then 'malformed record' else 'good' end as error_reason,
      {big('count(*)', 'n')} from feed where k % 101 <> 0 and k % 103 <> 0 group by 2"""
    q["a3_stream_orders"] = f"""{q["a3_storefront_orders"]} union all
      select case when o_orderkey % 97 = 0 then 'malformed record' else 'gross_revenue: not a number: BAD' end as reason, cast(count(*) as varchar),
        null, null, null, null, null, null from orders where o_orderkey % 89 = 0 or o_orderkey % 97 = 0 group by 1"""
    q["a3_quarantine"] = f"""select 'storefront' as source_system, case when o_orderkey % 97 = 0 then 'malformed record' else 'gross_revenue: not a number: BAD' end as error_reason,
      {big('count(*)', 'n')} from orders where o_orderkey % 89 = 0 or o_orderkey % 97 = 0 group by 2"""
    q["a4_ad_insights"] = f"""select {day('l_shipdate', 'date')}, 'Meta Ads' as channel, {dbl('sum(cast(l_extendedprice as decimal(12,2)))', 'spend')},
      {big('sum(l_linenumber)', 'clicks')}, {big("sum(case when l_returnflag <> 'A' then l_quantity else 0 end)", 'impressions')}
      from lineitem where l_partkey % 83 <> 0 and cast(l_shipdate as date) between date '2001-06-30' - interval 365 day and date '2001-06-30' group by l_shipdate"""
    q["a4_quarantine"] = f"""select 'insights' as source_system, 'spend: not a number: 1,5' as error_reason, {big('count(*)', 'n')} from lineitem
      where l_partkey % 83 = 0 and cast(l_shipdate as date) between date '2001-06-30' - interval 365 day and date '2001-06-30' having count(*) > 0"""
    revenue = "coalesce(case when event_type <> 'click' then cast(value as decimal(12,2)) end, 0)"
    q["a5_order_events"] = f"""select case when event_type <> 'view' then cast(event_id as varchar) else 'ORD_' || cast(floor(epoch(ts)) as bigint) || '_'
        || left(md5(case when event_type <> 'error' then cast(user_id as varchar) else '' end || '|' || case when event_type <> 'click' then cast(cast(value as decimal(12,2)) as varchar) else '' end), 12) end as order_id,
      'CUST_' || left(sha256(case when event_type <> 'error' then cast(user_id as varchar) else 'GUEST' end || '_salt'), 16) as customer_id,
      {stamp('ts', 'order_date')}, {dbl(revenue, 'gross_revenue')}, {dbl(f'round({revenue} * {_C35}, 2)', 'cogs')},
      cast(5 as double) as shipping_cost, 'Shopify Web' as acquisition_channel, 'Completed' as status from events where (event_type = 'click' or event_id % 79 <> 0)"""
    q["a5_quarantine"] = f"""select 'webhook' as source_system, 'gross_revenue: not a number: BAD' as error_reason, {big('count(*)', 'n')} from events
      where event_type <> 'click' and event_id % 79 = 0 having count(*) > 0"""
    q["a5_stream_quarantine"] = f"""select 'webhook' as source_system, 'good' as error_reason, {big('count(distinct order_id)', 'n')}
        from ({q["a5_order_events"]} and event_id % 97 <> 0)
      union all select 'webhook', 'malformed record', {big('count(*)', 'n')} from events where event_id % 97 = 0
      union all select 'webhook', 'gross_revenue: not a number: BAD', {big('count(*)', 'n')} from events
        where event_type <> 'click' and event_id % 79 = 0 and event_id % 97 <> 0 having count(*) > 0"""
    q["a8_good_orders"] = f"""with {_FEED} select order_id, customer_id, {stamp('order_date')}, {dbl('gross_revenue')}, {dbl('cogs')},
      cast(0 as double) as shipping_cost, coalesce(acquisition_channel, 'Organic / Direct') as acquisition_channel, status,
      {_GOOD_TAIL}, '' as landing_site from feed where k % 101 <> 0 and k % 103 <> 0"""
    q["a8_quarantine"] = f"""with {_FEED} select 'feed' as source_system, order_id, customer_id, order_date_text as order_date, revenue_text as gross_revenue,
      case when k % 103 = 0 then 'order_date: not a timestamp: someday' else '' end
      || case when k % 103 = 0 and k % 101 = 0 then '; ' else '' end
      || case when k % 101 = 0 then 'gross_revenue: not a number: ten' else '' end as error_reason
      from feed where k % 101 = 0 or k % 103 = 0"""
    q["a9_upsert"] = f"""with {RAW},
      t as (select * from raw where acquisition_channel is distinct from 'TikTok Ads'),
      u as (select * from raw where acquisition_channel is distinct from 'Meta Ads')
      select coalesce(t.order_id, u.order_id) as order_id, coalesce(t.customer_id, u.customer_id) as customer_id,
        strftime(coalesce(t.order_date, u.order_date), '%Y-%m-%d %H:%M:%S') as order_date,
        {dbl('case when u.order_id is not null then u.gross_revenue + 1 else t.gross_revenue end', 'gross_revenue')},
        {dbl('coalesce(u.cogs, t.cogs)', 'cogs')}, {dbl('coalesce(u.shipping_cost, t.shipping_cost)', 'shipping_cost')},
        case when u.order_id is not null then u.acquisition_channel else t.acquisition_channel end as acquisition_channel,
        case when u.order_id is not null then 'Refunded' else t.status end as status
      from t full outer join u on t.order_id = u.order_id"""
    q["a10_ingest_counters"] = f"""with {_FEED} select {big("count(case when k % 101 <> 0 and k % 103 <> 0 then 1 end)", 'successful')},
      {big("count(case when k % 101 = 0 or k % 103 = 0 then 1 end)", 'quarantined')} from feed"""
    q["a9_stored"] = q["a9_upsert"]
    q["a10_write_counters"] = q["a10_ingest_counters"]
    q["a11_customers_export"] = f"""with {HALF}, {_SEGMENTED} select 'Buyer "' || customer_id || '", Esq.' as name, customer_id || '@example.com' as email,
      label as segment, cast(n as varchar) as orders, cast(cast(spend as decimal(22,2)) as varchar) as ltv,
      strftime(first_at, '%Y-%m-%dT%H:%M:%S.000Z') as first_order_at, strftime(last_at, '%Y-%m-%dT%H:%M:%S.000Z') as last_order_at
      from sg join lab on sg.segment = lab.segment"""
    q["a12_orders_export_csv"] = f"""with {HALF} select order_id as order_number, acquisition_channel as channel, status, cast(gross_revenue as varchar) as revenue,
      cast(cogs as varchar) as cogs, cast(shipping_cost as varchar) as shipping, strftime(order_date, '%Y-%m-%dT%H:%M:%S.000Z') as created_at from h"""
    q["a13_mart_views"] = f"""with {STORE}, {_LTV.format(src='o', good='Completed')}, {_COHORT} select tier as customer_segment, {big('count(*)', 'customers')},
      {dbl('sum(rev)', 'lifetime_revenue')}, strftime((select max(cohort) from c), '%Y-%m-%d') as last_month from lt group by 1"""
    loss = _LOSS_ALERT.format(cols=_DATE_COL)
    q["a14_alert_sink"] = f"{_STORE_DAILY} {loss} from d where rev > 0 and profit < 0"
    q["a15_ad_spend_upsert"] = f"""with {ADS} select {day('ad_date', 'date')}, channel, campaign_id,
      {dbl("sum(ad_spend) * case when channel = 'Meta Ads' then 1 else 2 end", 'spend')}, {big('sum(impressions)', 'impressions')},
      {big('sum(clicks)', 'clicks')}, 'USD' as currency from a group by ad_date, channel, campaign_id"""
    q["a14_alerts_once"] = q["a14_alert_sink"]
    q["a15_stored"] = q["a15_ad_spend_upsert"]

    q["a7_workspace_scan"] = f"with {RAW} select workspace_id, {big('count(*)', 'orders')}, {dbl('sum(gross_revenue)', 'revenue')} from raw group by 1 union all select 'ws1 alone', {big('count(*)', 'orders')}, {dbl('sum(gross_revenue)', 'revenue')} from raw where workspace_id = 'ws1'"
    q["b1_stg_orders"] = f"""with {STORE} select order_id, customer_id, {stamp('order_timestamp')}, {day('order_date')}, {dbl('gross_revenue')}, {dbl('cogs')},
      {dbl('shipping_cost')}, acquisition_channel, status, {big('is_completed_order')}, {dbl('net_margin')} from o"""
    q["b2_stg_ad_spend"] = f"with {ADS} select {day('ad_date')}, channel, {dbl('ad_spend')}, clicks, impressions from a"

    q["d1_daily_unit_economics"] = D1
    q["d1_daily_unit_economics_keyed"] = D1
    extras = ", ".join(
        big(c, n)
        for c, n in (("buyers", "total_customers"), ("clicks", "total_clicks"), ("imp", "total_impressions"))
    )
    q["d1_daily_extended"] = f"{_STORE_DAILY} select {_DAILY_COLS}, {extras}, {dbl('cogs', 'total_cogs')}, {dbl('ship', 'total_shipping')} from d"
    q["d1_daily_by_workspace"] = f"with {STORE}, {ADS}, {daily('o', 'a', 'Completed', 'workspace_id')} select workspace_id, {_DAILY_COLS} from d"
    q["d2_channel_pnl"] = f"{_STORE_PNL} select {_PNL_COLS} from p"
    q["d3_channel_profitability"] = D3
    q["d4_attribution_share"] = f"""with {STORE}, g as (
      select acquisition_channel, count(distinct order_id) as n, sum(gross_revenue) as rev, sum(net_margin) as margin,
        count(gross_revenue) as c, sum(sum(gross_revenue)) over () as total
      from o where status = 'Completed' group by 1)
      select acquisition_channel, {big('n', 'attributed_orders')}, {dbl('rev', 'attributed_revenue')}, {dbl('margin', 'attributed_gross_margin')},
        {dbl(ratio('rev', 'c'), 'average_order_value')}, {dbl(pct('rev', 'total'), 'revenue_share_pct')} from g"""
    q["d5_velocity"] = D5
    q["d5_velocity_keyed"] = D5
    q["d6_customer_ltv"] = f"""with {STORE}, {_LTV.format(src='o', good='Completed')} select customer_id, {day('first_d', 'first_order_date')},
      {day('last_d', 'last_order_date')}, {big('n', 'total_lifetime_orders')}, {dbl('rev', 'lifetime_revenue')},
      {dbl('margin', 'lifetime_net_margin')}, tier as customer_segment from lt"""
    q["d6_approximate_customers"] = f"""with {STORE} select {big('year(order_date)', 'year')}, {big('count(order_id)', 'orders')},
      {big('count(distinct customer_id)', 'customers')}, true as within_four_errors from o where status = 'Completed' group by 1"""
    q["d7_cohort_retention"] = f"""with {STORE}, {_COHORT} select {day('cohort', 'cohort_month')}, {big('m', 'month_number')}, {big('n', 'active_customers')},
      {dbl('rev', 'cohort_revenue')}, {dbl('profit', 'cohort_net_profit')}, {big('size', 'initial_cohort_size')}, {dbl(pct('n', 'size'), 'retention_rate_pct')} from c"""
    # Cycle k has the customers with k orders or more; its revenue is that of their k-th ones.
    q["d8_cycle_churn"] = f"""with {STORE}, b as (
      select list(gross_revenue order by order_date, order_timestamp, order_id) as paid from o where status = 'Completed' group by customer_id),
      u as (
        select k, count(*) filter (len(paid) >= k) as n, case when k > 1 then count(*) filter (len(paid) >= k - 1) end as before,
          count(*) as base, sum(paid[k]) as rev, count(paid[k]) as c
        from b, range(1, 7) r(k) group by k)
      select {big('k', 'subscription_cycle')}, {big('n', 'active_subscribers')}, {dbl('rev', 'cycle_gross_revenue')}, {dbl(ratio('rev', 'c'), 'average_cycle_value')},
        {dbl(pct('n', 'base'), 'cycle_retention_pct')}, {dbl(f"round(100 - {pct('n', 'before', 8)}, 2)", 'cycle_churn_rate_pct')} from u where n > 0"""
    q["d9_mer"] = f"{_MER} select {_MER_COLS} from mer"
    week = "wk as (select * from mer where rev > 0 order by date desc limit 7)"
    q["d10_daily_breakdown"] = f"{_MER}, {week} select {_MER_COLS} from wk"
    q["d10_macro_summary"] = f"""{_MER}, {week}, t as (select sum(rev) as rev, sum(spend) as spend, sum(profit) as profit, sum(n) as n from wk)
      select {dbl('rev', 'gross_revenue')}, {dbl('spend', 'total_ad_spend')}, {dbl('profit', 'net_cash_profit')}, {big('n', 'total_orders')},
        {dbl(ratio0('rev', 'spend'), 'marketing_efficiency_ratio')}, {dbl(ratio0('spend', 'n'), 'blended_cac')}, {dbl(pct0('profit', 'rev'), 'net_margin_pct')} from t"""
    q["d11_channel_rollup"] = f"""{_STORE_PNL}, t as (
      select channel, sum(n) as n, sum(rev) as rev, sum(spend) as spend, sum(cogs) as cogs, sum(profit) as profit from p group by 1)
      select channel, {big('n', 'total_orders')}, {dbl('rev', 'attributed_revenue')}, {dbl('spend', 'channel_ad_spend')}, {dbl('cogs', 'attributed_cogs')},
        {dbl('profit', 'channel_net_profit')}, {dbl(ratio0('rev', 'spend'), 'channel_roas')} from t"""

    q["d12_overview"] = f"{overview()} select {_OVERVIEW_COLS} from v"
    q["d12_overview_by_workspace"] = f"{overview('workspace_id')} select workspace_id, {_OVERVIEW_COLS} from v"
    q["d13_trailing_deltas"] = f"{overview()} select {_DELTA_COLS} from v"
    q["d14_trend60"] = f"""with {HALF}, cal as (select cast(date '2025-05-02' + cast(i as integer) as date) as date from range(60) r(i)),
      x as (select cast(order_date as date) as date, sum(gross_revenue) as rev, count(*) as n from h where status = 'paid' group by 1),
      y as (select cast(date as date) as date, sum(spend) as spend from ha group by 1)
      select {day('cal.date', 'date')}, strftime(cal.date, '%b %-d') as label, {dbl('coalesce(rev, 0)', 'revenue')}, {dbl('coalesce(spend, 0)', 'ad_spend')},
        {big('coalesce(n, 0)', 'orders')} from cal left join x on cal.date = x.date left join y on cal.date = y.date"""
    q["d15_channel_breakdown"] = f"""{_BREAKDOWN} select channel, {big('position')}, {dbl('spend')}, {dbl('rev', 'revenue')}, {big('n', 'orders')},
      {big('conv', 'conversions')}, {big('imp', 'impressions')}, {big('clicks')}, roas, cac, {fratio('spend', 'imp')} * 1000.0 as cpm from bk"""
    q["d16_cohort_matrix"] = f"{_MATRIX} select {_MATRIX_COLS} from mt"
    q["d17_rfm_segments"] = f"""with {HALF}, {_SEGMENTED}, g as (select segment, count(*) as c, sum(spend) as spend, sum(n) as n from sg group by 1)
      select {big('position')}, g.segment, label, {big('c', 'customers')}, {dbl('spend', 'total_spend')},
        cast(spend as double) / cast(c as double) as avg_spend, cast(n as double) / cast(c as double) as avg_orders,
        cast(c as double) / cast((select sum(c) from g) as double) * 100.0 as share_pct from g join lab on g.segment = lab.segment"""
    q["d18_customer_kpis"] = f"""with {HALF}, {_SEGMENTED} select {big('count(*)', 'total_customers')},
      coalesce(cast(sum(spend) as double) / cast(count(*) as double), 0) as average_ltv, {big("count(case when segment = 'vip' then 1 end)", 'vip_customers')} from sg"""
    q["d19_spend_mix"] = f"{_BREAKDOWN}, t as (select sum(spend) as total from bk) select channel, {dbl('spend')}, {fratio('spend', 'total')} * 100.0 as share_pct from bk cross join t"
    profit = f"""with {HALF}, fl as (
      select order_date as happened, gross_revenue - cogs - shipping_cost as amt from h where status = 'paid'
      union all select date, -spend from ha),
      pr as (
        select coalesce(sum(case when happened >= {MID} - interval 7 day and happened < {MID} then amt end), 0) as week_profit,
          coalesce(sum(case when happened >= timestamp '2025-06-01' and happened < {MID} then amt end), 0) as month_profit from fl)"""
    q["d20_window_profit"] = f"{profit} select {dbl('week_profit')}, {dbl('month_profit')} from pr"
    q["d21_customer_rollup"] = f"""with {HALF}, {_CUSTOMERS} select customer_id, {stamp('first_at', 'first_order_at')}, {stamp('last_at', 'last_order_at')},
      {big('n', 'order_count')}, {dbl('spend', 'total_spend')} from cu"""

    q["f2_top_customers"] = f"""with {HALF}, {_SEGMENTED} select customer_id, {stamp('first_at', 'first_order_at')}, {stamp('last_at', 'last_order_at')},
      {big('n', 'order_count')}, {dbl('spend', 'total_spend')}, sg.segment, label as segment_label
      from sg join lab on sg.segment = lab.segment order by spend desc, customer_id limit 60"""
    q["f4_latest_per_key"] = f"""select user_id, event_id, {stamp('ts')}, event_type from events
      qualify row_number() over (partition by user_id order by ts desc, event_id) <= 8"""
    q["f5_best_worst_channel"] = f"""{_BREAKDOWN},
      hi as (select channel, roas from bk order by roas desc, position limit 1), lo as (select channel, roas from bk order by roas, position desc limit 1)
      select hi.channel as best_channel, hi.roas as best_roas, lo.channel as worst_channel, lo.roas as worst_roas from hi cross join lo"""
    newest = "nw as (select * from mt where m1 > 0 order by cohort desc limit 1)"
    q["f6_latest_returning_cohort"] = f"{_MATRIX}, {newest} select {day('cohort', 'cohort_month')}, label, m1 from nw"
    q["f7_latest_cohorts"] = f"{_MATRIX} select {_MATRIX_COLS} from (select * from mt order by cohort desc limit 6) z"

    q["g1_cac_surge"] = f"""{_SURGE} select {day('date')}, {big('n', 'total_orders')}, {dbl('cac', 'blended_cac')}, {big('prior', 'prior_days')},
      {dbl('mean7', 'trailing_cac')}, {dbl('change', 'cac_change_pct')}, surge as is_surge from su"""
    q["g1_cac_surge_alerts"] = f"{_SURGE} {_SURGE_ALERT.format(cols=_DATE_COL)} from su where surge"
    q["g2_loss_alerts"] = q["a14_alert_sink"]
    spiked = _SURGE.replace("as decimal(12,2)) as spend,", "as decimal(12,2)) * case when l_orderkey % 181 = 180 then 50 else 1 end as spend,")
    q["g1_g2_latest_alerts"] = f"""{spiked}, nd as (select max(date) as date from d where rev > 0)
      {_SURGE_ALERT.format(cols=_DATE_COL)} from su where surge and date = (select date from nd)
      union all {_LOSS_ALERT.format(cols=_DATE_COL)} from d where profit < 0 and rev > 0 and date = (select date from nd)"""
    q["d14_trend60_by_workspace"] = f"""with {HALF}, cal as (
        select 'ws' || cast(k as varchar) as workspace_id, cast(date '2025-05-02' + cast(i as integer) as date) as date from range(60) r(i), range(4) s(k)),
      x as (select workspace_id, cast(order_date as date) as date, sum(gross_revenue) as rev, count(*) as n from h where status = 'paid' group by 1, 2),
      y as (select workspace_id, cast(date as date) as date, sum(spend) as spend from ha group by 1, 2)
      select cal.workspace_id, {day('cal.date', 'date')}, strftime(cal.date, '%b %-d') as label, {dbl('coalesce(rev, 0)', 'revenue')},
        {dbl('coalesce(spend, 0)', 'ad_spend')}, {big('coalesce(n, 0)', 'orders')} from cal
      left join x on cal.date = x.date and cal.workspace_id = x.workspace_id left join y on cal.date = y.date and cal.workspace_id = y.workspace_id"""
    q["d15_channel_breakdown_by_workspace"] = f"""with {HALF}, fx as (
        select 'ws' || cast(k as varchar) as workspace_id, c.channel, c.position from range(4) s(k),
          (values ('Meta', 0), ('Google', 1), ('TikTok', 2)) c(channel, position)),
      x as (select workspace_id, acquisition_channel as channel, sum(gross_revenue) as rev, count(*) as n from h where status = 'paid' group by 1, 2),
      y as (select workspace_id, channel, sum(spend) as spend, sum(impressions) as imp, sum(clicks) as clicks, sum(conversions) as conv from ha group by 1, 2),
      bk as (select fx.workspace_id, fx.channel, fx.position, coalesce(spend, 0) as spend, coalesce(rev, 0) as rev, coalesce(n, 0) as n, coalesce(imp, 0) as imp,
          coalesce(clicks, 0) as clicks, coalesce(conv, 0) as conv from fx
        left join x on fx.workspace_id = x.workspace_id and fx.channel = x.channel left join y on fx.workspace_id = y.workspace_id and fx.channel = y.channel)
      select workspace_id, channel, {big('position')}, {dbl('spend')}, {dbl('rev', 'revenue')}, {big('n', 'orders')}, {big('conv', 'conversions')},
        {big('imp', 'impressions')}, {big('clicks')}, {fratio('rev', 'spend')} as roas, {fratio('spend', 'n')} as cac, {fratio('spend', 'imp')} * 1000.0 as cpm from bk"""
    q["g3_channel_insight"] = f"""{_BREAKDOWN},
      hi as (select channel, roas from bk order by roas desc, position limit 1), lo as (select channel, roas from bk order by roas, position desc limit 1)
      select cast(1 as bigint) as position, hi.channel || ' is outperforming the rest' as title,
        hi.channel || ' is returning ' || {fixed('hi.roas / lo.roas', 1)} || '× the ROAS of ' || lo.channel || ' (' || {fixed('hi.roas', 2)} || 'x vs '
        || {fixed('lo.roas', 2)} || 'x). Shift budget there.' as body, 'positive' as tone
      from hi cross join lo where hi.roas > 0 and lo.roas > 0 and hi.roas > lo.roas"""
    q["g4_profit_insight"] = f"""{profit} select cast(2 as bigint) as position,
      case when month_profit >= 0 then 'You''re generating profit' else 'You''re burning cash' end as title,
      'Profit in the last 7 days: ' || {currency('week_profit')} || ' · this month: ' || {currency('month_profit')} || '.' as body,
      case when month_profit >= 0 then 'positive' else 'negative' end as tone from pr"""
    q["g5_repeat_insight"] = f"""{_MATRIX}, {newest} select cast(3 as bigint) as position, 'Repeat purchases' as title,
      'Your ' || label || ' cohort is repurchasing at ' || {fixed('m1', 1)} || '% within 30 days. '
      || case when m1 >= 25 then 'Strong retention is driving CAC down.' else 'Room to improve with win-back flows.' end as body,
      case when m1 >= 25 then 'positive' when m1 >= 10 then 'neutral' else 'negative' end as tone from nw"""
    q["g6_cac_insight"] = f"""{overview()}, z as (select *, {delta('cac1', 'cac0')} as dl from v)
      select cast(4 as bigint) as position,
        case when dl <= -1 then 'Acquisition cost is falling' when dl >= 1 then 'Acquisition cost is rising' else 'Acquisition cost is stable' end as title,
        case when dl <= -1 then 'Blended CAC is down ' || {fixed('abs(dl)', 0)} || '% in the last 14 days — you''re acquiring customers cheaper.'
          when dl >= 1 then 'Blended CAC is up ' || {fixed('dl', 0)} || '% in the last 14 days. Watch your least efficient channel.'
          else 'Blended CAC is holding steady at ' || {currency('cac')} || '.' end as body,
        case when dl <= -1 then 'positive' when dl >= 1 then 'negative' else 'neutral' end as tone from z"""
    q["g3_g6_insights"] = " union all ".join(
        f"select position, title, body, tone from ({q[n]}) z{i}"
        for i, n in enumerate(("g3_channel_insight", "g4_profit_insight", "g5_repeat_insight", "g6_cac_insight"))
    )
    newest_day = "nd as (select * from mer where rev > 0 order by date desc limit 1)"
    brief = f"""{day('nd.date', 'date')}, {big('n', 'total_orders')}, {dbl('rev', 'gross_revenue')}, {dbl('spend', 'total_ad_spend')}, {dbl('profit', 'net_cash_profit')},
      {dbl('roas', 'marketing_efficiency_ratio')}, {dbl('cac', 'blended_cac')},
      'Briefing: Sales: $' || {grouped('rev', 2)} || ' | Net Profit: ' || case when profit >= 0 then '+' else '-' end || '$' || {grouped('abs(profit)', 2)}
      || ' | MER: ' || {fixed('roas', 2)} || 'x' as summary"""
    q["g7_briefing"] = f"{_MER}, {newest_day} select {brief} from nd"
    q["g8_scorecard"] = f"""{overview()} select {currency('rev', True)} as revenue, {fixed('roas', 2)} || 'x' as blended_roas, {currency('cac')} as blended_cac,
      {currency('cm1', True)} as contribution_margin,
      'Today''s KPI scorecard (ROAS ' || {fixed('roas', 2)} || 'x · CAC $' || {fixed('cac', 2)} || ') was delivered.' as message from v"""

    q["h7_attribution"] = f"with {LANDED} select {verdict('r', 'u')} from rule"
    q["h7_attribution_strict"] = f"with {LANDED} select {verdict('strict_r', 'url')} from rule"
    q["h9_fx"] = f"""with {RAW} select order_id, cast(round(gross_revenue * case k % 8 when 1 then cast(1.08 as decimal(10,6)) when 6 then cast(1.08 as decimal(10,6))
      when 2 then cast(1.28 as decimal(10,6)) when 3 then cast(0.74 as decimal(10,6)) when 4 then cast(0.65 as decimal(10,6))
      when 5 then cast(0.0119 as decimal(10,6)) else cast(1 as decimal(10,6)) end, 2) as double) as gross_usd from raw"""
    q["c9_fx_table"] = q["h9_fx"]
    q["x10_hashed_ids"] = """select 'CUST_' || left(sha256(cast(c_custkey as varchar) || '_salt'), 16) as customer_id,
      'CUST_' || left(sha256(c_name || '_salt'), 16) as name, c_mktsegment as market from customer"""
    q["h10_pseudonym"] = f"with {RAW} select order_id, 'CUST_' || left(sha256(customer_id || '_salt'), 16) as customer_token from raw"
    q["h18_segments"] = f"""with {HALF}, {_SEGMENTED} select customer_id, {big('rec', 'recency_days')}, sg.segment, label as segment_label
      from sg join lab on sg.segment = lab.segment"""
    q["h22_report_text"] = f"""with {RAW}, s as (select *, gross_revenue * cast(0.0001 as decimal(5,4)) as share from raw)
      select order_id, {currency('gross_revenue')} as money, {currency('(-share)')} as small_money, {currency('(gross_revenue * 10)', True)} as compact_money,
        format('{{:,}}', k) as number, {fixed('share', 1)} || '%' as percent, {fixed('share', 2)} || 'x' as multiplier,
        strftime(order_date, '%b %y') as month, strftime(order_date, '%b %-d') as day from s"""

    q["i1_stream_ingest"] = f"""with {RAW} select order_id, customer_id, {stamp('order_date')}, {dbl('gross_revenue + case when k % 5 = 0 then 1 else 0 end', 'gross_revenue')}, {dbl('cogs')}, cast(0 as double) as shipping_cost,
      cast(0 as double) as taxes, cast(0 as double) as discounts, 'Organic / Direct' as acquisition_channel, case when k % 5 = 0 then 'Refunded' else 'Completed' end as status, 'USD' as currency
      from raw where k % 101 <> 0"""
    # Orders of the first year that come years late are not in the live sums.
    timely = "timely as (select * from o where not (k % 7 = 0 and year(order_date) < 1996))"
    q["i2_live_daily"] = f"with {STORE}, {ADS}, {timely}, {daily('timely', 'a', 'Completed')} select {_DAILY_COLS} from d"
    q["i2_status_change"] = D1
    q["i2_corrected_days"] = D1
    ev = """ev as (
      select event_id, ts, user_id, event_type, 'cus_' || cast(user_id + event_id % 2 as varchar) as customer, event_id % 2 = 0 as even,
        cast(value * 100 as bigint) as cents from events)"""
    q["i3_payments"] = f"""with {ev.replace('cast(value * 100 as bigint)', 'cast(trunc(value * 100) as bigint)')} select user_id,
      {dbl('case when even then cents * cast(0.01 as decimal(3,2)) else 499 end', 'amount')}, 'usd' as currency, 'paid' as status, 'stripe' as provider,
      'cs_' || cast(event_id as varchar) as provider_id from ev where event_type = 'signup' and user_id > 0"""
    # A cancellation hits the user whose checkout named the customer last, if that user has bought under no other since.
    q["i3_current_plans"] = f"""with {ev},
      b as (select *, (ts, event_id) as pt, case when even then 'enterprise' else 'pro' end as plan from ev where event_type = 'signup' and user_id > 0),
      hit as (
        select x.customer, (x.ts, x.event_id) as pt, arg_max(b.user_id, b.pt) as user_id
        from ev x join b on b.customer = x.customer and b.pt < (x.ts, x.event_id) where x.event_type = 'error' group by 1, 2),
      mine as (select user_id, max(pt) as pt, arg_max(plan, pt) as plan, arg_max(customer, pt) as customer from b group by 1)
      select user_id, case when exists (
          select 1 from hit where hit.user_id = mine.user_id and hit.customer = mine.customer and hit.pt > mine.pt)
        then 'trial' else plan end as plan from mine"""
    q["i3_activity"] = f"""with {ev},
      b as (select *, (ts, event_id) as pt, case when even then 'enterprise' else 'pro' end as plan from ev where event_type = 'signup' and user_id > 0),
      hit as (
        select x.ts, x.event_id, x.customer, arg_max(b.user_id, b.pt) as user_id
        from ev x join b on b.customer = x.customer and b.pt < (x.ts, x.event_id) where x.event_type = 'error' group by 1, 2, 3)
      select user_id, 'billing.upgrade' as action, 'Upgraded to ' || plan || ' via Stripe' as detail, {stamp('ts', '"at"')} from b
      union all select hit.user_id, 'billing.canceled', 'Subscription canceled — downgraded to Trial', {stamp('hit.ts', '"at"')} from hit
      where hit.customer = (select arg_max(b.customer, b.pt) from b where b.user_id = hit.user_id and b.pt < (hit.ts, hit.event_id))"""
    q["i3_stream_plans"] = q["i3_current_plans"]
    q["i3_state_plans"] = q["i3_current_plans"]

    for name, allowed, seconds in (("audit", 10, 600), ("hourly", 3, 3600), ("long", 10, 432_000)):
        q[f"i4_throttle_{name}" if name != "audit" else "i4_throttle_audit"] = f"""with recursive e as (
            select user_id, ts, count(*) as n from events group by all),
          w(user_id, anchor) as (
            select user_id, min(ts) from e group by 1
            union all
            select w.user_id, (select min(ts) from e where e.user_id = w.user_id and e.ts > w.anchor + interval {seconds} second) as nx
            from w where nx is not null),
          b as (select e.user_id, e.n, w.anchor from e asof join w on w.user_id = e.user_id and w.anchor <= e.ts),
          c as (select user_id, anchor, sum(n) as n from b group by 1, 2)
          select cast(user_id as varchar) as key, {stamp('anchor', 'window_start')}, {big('n', 'events')},
            {big(f'least(n, {allowed})', 'allowed')}, {big(f'n - least(n, {allowed})', 'rejected')} from c"""

    q["i4_stream"] = q["i4_throttle_audit"]

    active = f"{_HALF_DAILY}, act as (select date, cac, roas, rev from d where rev > 0)"
    refunds = f"""rf as (select date, {pct('r', 'n')} as rate from (
      select cast(order_date as date) as date, count(case when status = 'refunded' then 1 end) as r, count(distinct order_id) as n from h group by 1) z0)"""
    q["x1_zscore"] = f"""{active}, {refunds} {zmetric('act', 'cac', 'blended_cac')} union all {zmetric('act', 'roas', 'blended_roas')}
      union all {zmetric('act', 'rev', 'total_revenue')} union all {zmetric('rf', 'rate', 'refund_rate_pct')}"""
    gm = "rev - cogs - ship"
    q["x2_roas_decay"] = f"""{_STORE_PNL} select {day('date')}, channel, {dbl(ratio0('rev', 'spend'), 'channel_roas')},
      {dbl(f"case when {gm} > 0 then {ratio('rev', f'({gm})', 4)} end", 'break_even_roas')}, {gm} < spend as is_below_break_even
      from p where spend > 0"""
    q["x3_return_spikes"] = f"""with {LINES}, g as (
      select sku, cast(date_trunc('month', line_date) as date) as period, sum(units) as units, sum(case when returned then units else 0 end) as back from li group by 1, 2),
      r as (select *, {pct('back', 'units')} as rate from g)
      select sku, {day('period')}, {big('units')}, {big('back', 'units_returned')}, cast(rate as double) as return_rate_pct, {_Z} as z_score,
        coalesce(abs({_Z}) >= 3, false) as is_anomaly from {zscore('r', 'rate', 'period', 'sku')} z"""
    q["x4_sku_margin"] = f"""with {LINES},
      tot as (select order_id, sum(revenue) as total from li group by 1),
      s as (
        select sku, count(*) as n, sum(units) as units, sum(case when returned then units else 0 end) as back, sum(revenue) as rev,
          coalesce(sum(case when returned then revenue end), 0) as refund, sum(goods) as goods,
          round(cast(sum((cast(10000000 as hugeint) * cast(revenue * 100 as hugeint) + cast(total * 100 as hugeint))
            // (2 * cast(total * 100 as hugeint))) as decimal(28,0)) * cast(0.000001 as decimal(7,6)), 2) as ship
        from li join tot on li.order_id = tot.order_id group by 1),
      p as (select *, rev - refund - goods - ship as profit from s)
      select sku, {big('n', 'order_lines')}, {big('units', 'units_sold')}, {big('back', 'units_returned')}, {dbl('rev', 'gross_revenue')}, {dbl('refund', 'refunded_revenue')},
        {dbl('goods', 'total_cogs')}, {dbl('ship', 'allocated_shipping')}, {dbl('profit', 'net_profit')}, {dbl(pct('back', 'units'), 'return_rate_pct')},
        {dbl(pct('profit', 'rev'), 'net_margin_pct')} from p"""
    q["x5_stock_runway"] = f"""with {LINES}, s as (
      select sku, sum(units) as units from li where line_date >= date '2001-05-31' and line_date < date '2001-06-30' group by 1),
      st as (select cast(p_partkey as varchar) as sku, cast(p_size as bigint) * 10 as on_hand from part)
      select st.sku, on_hand, {big('coalesce(units, 0)', 'units_sold')}, {dbl(ratio('coalesce(units, 0)', '30'), 'daily_velocity')},
        {dbl(ratio('on_hand * 30', 'units', 1), 'days_left')} from st left join s on st.sku = s.sku"""
    counts = ", ".join(f"count(case when gap <= {d} then 1 end) as r{d}" for d in (30, 60, 90))
    shares = ", ".join(
        f"{big(f'r{d}', f'repurchased_{d}d')}, {dbl(pct(f'r{d}', 'n'), f'repurchase_{d}d_pct')}" for d in (30, 60, 90)
    )
    q["x6_repurchase_30_60_90"] = f"""with {STORE}, s as (
      select customer_id, order_date, row_number() over (partition by customer_id order by order_date, order_timestamp, order_id) as seq from o where status = 'Completed'),
      f as (select customer_id, order_date as d1 from s where seq = 1), g as (select customer_id, order_date as d2 from s where seq = 2),
      k as (select f.customer_id, d1, date_diff('day', d1, d2) as gap from f left join g on f.customer_id = g.customer_id),
      c as (select date_trunc('month', d1) as cohort, count(*) as n, {counts} from k group by 1)
      select {day('cohort', 'cohort_month')}, {big('n', 'customers')}, {shares} from c"""
    q["x7_tier_revenue_share"] = f"""with {HALF}, {_LTV.format(src='h', good='paid')}, g as (select tier, count(*) as n, sum(rev) as rev from lt group by 1)
      select tier as customer_segment, {big('n', 'customers')}, {dbl('rev', 'revenue')}, {dbl(pct('rev', '(select sum(rev) from g)'), 'revenue_share_pct')} from g"""
    split = currency("sp", True)
    q["x8_full_briefing"] = f"""{_MER}, {LINES}, {newest_day},
      cs as (select channel, sum(ad_spend) as sp from a where ad_date = (select date from nd) group by 1),
      sp as (select string_agg(channel || ': ' || {split}, ', ' order by channel) as spend_split from cs where sp > 0),
      bs as (select sku, sum(units) as u from li where line_date = (select date from nd) group by 1 order by u desc, sku limit 1)
      select {brief}, spend_split, bs.sku as best_seller, {big('bs.u', 'best_seller_units')} from nd left join sp on true left join bs on true"""
    q["x9_claimed_vs_resolved"] = f"""with {LANDED}, {ADS},
      cl as (
        select 'Amazon Marketplace' as channel, gross_revenue as claimed, 0 as earned, 0 as won from low where t like '%amazon%' or t like '%fba%' or s like '%amz%'
        union all select 'Meta Ads', gross_revenue, 0, 0 from low where u like '%fbclid=%' or s like '%facebook%' or s like '%fb%' or s like '%instagram%' or s like '%ig%'
        union all select 'Google Ads', gross_revenue, 0, 0 from low where u like '%gclid=%' or u like '%wbraid=%' or u like '%gbraid=%' or s like '%google%' or s like '%pmax%' or s like '%youtube%'
        union all select 'TikTok Ads', gross_revenue, 0, 0 from low where u like '%ttclid=%' or s like '%tiktok%'
        union all select {resolved()}, 0, gross_revenue, 1 from rule),
      g as (select channel, sum(won) as won, sum(claimed) as claimed, sum(earned) as earned from cl group by 1),
      sp as (select channel, sum(ad_spend) as spend from a group by 1),
      z as (select g.*, coalesce(spend, 0) as spend from g left join sp on g.channel = sp.channel)
      select channel, {big('won', 'resolved_orders')}, {dbl('claimed', 'claimed_revenue')}, {dbl('earned', 'resolved_revenue')}, {dbl('spend', 'ad_spend')},
        {dbl(ratio0('claimed', 'spend'), 'claimed_roas')}, {dbl(ratio0('earned', 'spend'), 'true_roas')} from z"""
    q["x9_resolved_channel_pnl"] = f"""with {LANDED}, {ADS}, ro as (select * replace (cast(order_date as date) as order_date) from rule), {pnl('ro', resolved())}
      select {_PNL_COLS} from p"""
    views = {
        "stg_orders": ("b1_stg_orders", "net_margin"), "stg_ad_spend": ("b2_stg_ad_spend", "ad_spend"),
        "fct_daily_unit_economics": ("d1_daily_unit_economics", "net_profit"), "fct_channel_attributed_pnl": ("d2_channel_pnl", "channel_net_profit"),
        "fct_product_profitability": ("d3_channel_profitability", "total_net_profit"), "fct_multi_touch_attribution": ("d4_attribution_share", "attributed_revenue"),
        "fct_inventory_runway": ("d5_velocity", "daily_burn_velocity"), "fct_customer_cohort_retention": ("d7_cohort_retention", "cohort_net_profit"),
        "fct_subscription_churn_velocity": ("d8_cycle_churn", "cycle_gross_revenue"), "fct_marketing_efficiency_ratio": ("d9_mer", "net_cash_profit"),
        "dim_customer_ltv": ("d6_customer_ltv", "lifetime_revenue"),
    }
    q["a13_all_views"] = " union all ".join(
        f"select '{v}' as mart, count(*) as rows, cast(sum(cast({c} as decimal(28,2))) as double) as total from ({q[k]})" for v, (k, c) in views.items()
    )
    q["a13_refreshed_days"] = q["a13_all_views"]
    # Mart, what it comes from, leading column, its whole order, and what breaks ties.
    orders = (
        ("fct_daily_unit_economics", "d1_daily_unit_economics", "date", "date desc", None),
        ("fct_channel_attributed_pnl", "d2_channel_pnl", "date", "date desc, channel_net_profit desc", "channel"),
        ("fct_product_profitability", "d3_channel_profitability", "total_net_profit", "total_net_profit desc", "acquisition_channel"),
        ("fct_multi_touch_attribution", "d4_attribution_share", "attributed_revenue", "attributed_revenue desc", "acquisition_channel"),
        ("fct_inventory_runway", "d5_velocity", "daily_burn_velocity", "daily_burn_velocity desc", "acquisition_channel"),
        ("dim_customer_ltv", "d6_customer_ltv", "lifetime_revenue", "lifetime_revenue desc", "customer_id"),
        ("fct_customer_cohort_retention", "d7_cohort_retention", "cohort_month", "cohort_month desc, month_number", None),
        ("fct_subscription_churn_velocity", "d8_cycle_churn", "subscription_cycle", "subscription_cycle", None),
        ("channel_rollup", "d11_channel_rollup", "channel_net_profit", "channel_net_profit desc", "channel"),
    )
    q["f1_ordered_marts"] = " union all ".join(
        f"""select '{m}' as mart, row_number() over (order by {o.replace(' desc', ' desc nulls last')}{f', {tie} nulls last' if tie else ''}) as position,
          cast({tie or 'null'} as varchar) as key,
          {lead if lead in ('date', 'cohort_month') else f'cast(cast({lead} as decimal(20,2)) as varchar)'} as value from ({q[k]})"""
        for m, k, lead, o, tie in orders
    )
    return q


ORACLE: dict[str, str] = _oracle()
