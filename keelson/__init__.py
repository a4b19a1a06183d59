"""Spark jobs that follow how published contracts, JSON payloads and text corpora change."""
