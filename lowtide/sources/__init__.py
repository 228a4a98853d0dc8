"""Readers, document flatteners and the adapters over the benchmark tables."""
