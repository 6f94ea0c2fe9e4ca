"""Whole plans: the interpretation lineage, the month view, the ledger over the test tables, registered queries."""
