"""Whole flows and the queries registered for the correctness check."""
