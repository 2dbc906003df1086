"""Structured Streaming jobs: order ingest, live economics, billing, throttling."""
