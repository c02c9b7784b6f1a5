"""Whole jobs: packages from tables to verdicts."""
