"""Bars over a stream of trade-like events."""
