"""Customer, channel and stock labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments in display order with their labels.
SEGMENT_LABELS = {
    "vip": "VIP",
    "loyal": "Loyal",
    "promising": "Promising",
    "new": "New",
    "at_risk": "At risk",
    "lost": "Lost",
    "active": "Active",
}


# Limits of the segments.
def rfm_segment(order_count: Column, total_spend: Column, recency: Column) -> Column:
    """Recency/frequency/monetary segment; the first rule that holds wins."""
    return (
        F.when((total_spend >= 400) | (order_count >= 4), "vip")
        .when(recency > 120, "lost")
        .when(recency > 60, "at_risk")
        .when((order_count == 1) & (recency <= 30), "new")
        .when(order_count >= 2, "loyal")
        .when(total_spend >= 150, "promising")
        .otherwise("active")
    )


def segment_label(segment: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SEGMENT_LABELS.items()))
    return F.try_element_at(table, segment)


def segment_rank(segment: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SEGMENT_LABELS])
    return F.array_position(names, segment).cast("int")


# Limits and labels of the loyalty tiers.
def loyalty_tier(orders: Column) -> Column:
    return (
        F.when(orders >= 4, "Champion (VIP)")
        .when(orders >= 2, "Loyal Customer")
        .otherwise("One-Time Buyer")
    )


# Limits and labels of the sales velocity.
def velocity_label(velocity: Column) -> Column:
    return (
        F.when(velocity > 15, "High Velocity (Scale Ad Budget)")
        .when(velocity > 5, "Moderate Velocity")
        .otherwise("Low Velocity (Needs Creative Refresh)")
    )
