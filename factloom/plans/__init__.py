"""Registered queries: adapters over the given tables, Spark plans and their SQL oracles."""
