"""Readers for the practice tables, the test-table views and catalog lookups."""
