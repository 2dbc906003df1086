"""Bindings to the sample tables, the warehouse views, queries and their SQL oracles."""
