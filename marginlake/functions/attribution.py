"""Marketing attribution of an order from its landing URL, UTM source and tags."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel names, tiers and confidence scores.
AMAZON = "Amazon Marketplace"
META = "Meta Ads"
GOOGLE = "Google Ads"
TIKTOK = "TikTok Ads"
OWNED = "Organic, Direct & Klaviyo Email"
CHANNELS = (AMAZON, META, GOOGLE, TIKTOK, OWNED)

MARKETPLACE_TIER = ("TIER_3_MARKETPLACE", 1.0)
CLICK_TIER = ("TIER_1_CLICK_ID", 0.95)
UTM_TIER = ("TIER_2_UTM", 0.80)
RETENTION_TIER = ("TIER_2_UTM_RETENTION", 0.90)
ORGANIC_TIER = ("TIER_4_DIRECT_ORGANIC", 0.70)

# Evidence looked for, per channel.
AMAZON_TAGS = ("amazon", "fba")
AMAZON_SOURCES = ("amz",)
CLICK_PARAMS = {
    META: ("fbclid",),
    GOOGLE: ("gclid", "wbraid", "gbraid"),
    TIKTOK: ("ttclid",),
}
UTM_SOURCES = {
    META: ("facebook", "fb", "instagram", "ig"),
    GOOGLE: ("google", "pmax", "youtube"),
    TIKTOK: ("tiktok",),
}
RETENTION_SOURCES = ("klaviyo", "email")


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def _mentions(text: Column, words: tuple[str, ...], strict: bool = False) -> Column:
    """Any word inside ``text``; ``strict`` wants whole tokens instead of substrings."""
    if strict:
        tokens = F.split(text, "[^a-z0-9]+")
        return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def _has_param(url: Column, params: tuple[str, ...]) -> Column:
    return _mentions(url, tuple(f"{p}=" for p in params))


def click_id(url: Column, param: str, preserve_case: bool = False) -> Column:
    """Value of a click-id parameter, or NULL. Lower-cased unless asked otherwise."""
    text = F.coalesce(url, F.lit("")) if preserve_case else _text(url)
    found = F.regexp_extract(text, f"(?i){param}=([a-zA-Z0-9_-]+)", 1)
    return F.nullif(found, F.lit(""))


def _verdict(channel: str, tier: tuple[str, float], click: Column | None = None) -> Column:
    return F.struct(
        F.lit(channel).alias("channel"),
        F.lit(tier[0]).alias("attribution_tier"),
        F.lit(tier[1]).alias("confidence_score"),
        (F.lit(None).cast("string") if click is None else click).alias("click_id"),
    )


def resolve_attribution(
    landing_url: Column,
    utm_source: Column,
    order_tags: Column,
    *,
    strict: bool = False,
    preserve_case: bool = False,
) -> Column:
    """One channel per order, by the strongest evidence.

    Marketplace orders come first, then click ids, then UTM sources, then owned
    traffic. Result: struct(channel, attribution_tier, confidence_score, click_id).
    """
    url, source, tags = _text(landing_url), _text(utm_source), _text(order_tags)

    marketplace = _mentions(tags, AMAZON_TAGS) | _mentions(source, AMAZON_SOURCES)
    verdict = F.when(marketplace, _verdict(AMAZON, MARKETPLACE_TIER))
    for channel, params in CLICK_PARAMS.items():
        # Only a channel's first parameter carries an id worth keeping.
        found = click_id(landing_url, params[0], preserve_case)
        verdict = verdict.when(_has_param(url, params), _verdict(channel, CLICK_TIER, found))
    for channel, words in UTM_SOURCES.items():
        verdict = verdict.when(_mentions(source, words, strict), _verdict(channel, UTM_TIER))
    verdict = verdict.when(
        _mentions(source, RETENTION_SOURCES, strict), _verdict(OWNED, RETENTION_TIER)
    )
    return verdict.otherwise(_verdict(OWNED, ORGANIC_TIER))


def platform_claims(
    landing_url: Column, utm_source: Column, order_tags: Column
) -> dict[str, Column]:
    """Channel -> whether its platform has any evidence to claim the order."""
    url, source, tags = _text(landing_url), _text(utm_source), _text(order_tags)
    claims = {AMAZON: _mentions(tags, AMAZON_TAGS) | _mentions(source, AMAZON_SOURCES)}
    for channel, params in CLICK_PARAMS.items():
        claims[channel] = _has_param(url, params) | _mentions(source, UTM_SOURCES[channel])
    return claims
