"""Ledger analytics on Spark: statement files to facts, facts to an interpretation, both to a month view."""
