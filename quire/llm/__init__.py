"""Operators of a training-data pipeline (mixing, scans, dedup, scoring, archives)."""
