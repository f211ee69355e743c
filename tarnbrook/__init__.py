"""Keyed JSON documents on PySpark: an operation log folded into current state, with snapshots and envelopes."""

__version__ = "0.1.0"
