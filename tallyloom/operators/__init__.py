"""Ledger operators: rings, classification, matching, reconciliation, merchants, deduplication."""
