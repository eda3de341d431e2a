"""Whole jobs: operators chained into marts and reports."""
