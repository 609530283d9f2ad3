"""Quantloom: market-panel analytics expressed as Spark plans."""
