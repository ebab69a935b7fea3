"""Ledger auditing and revenue analytics as Spark DataFrame operations."""
