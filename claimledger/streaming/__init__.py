"""Structured Streaming forms of the ledger gate."""
