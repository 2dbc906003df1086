"""Staging, marts, KPIs, detection and SKU operators."""
