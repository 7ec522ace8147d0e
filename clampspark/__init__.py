"""Spark operators for archives of fixed-rate, multi-channel signal recordings."""
