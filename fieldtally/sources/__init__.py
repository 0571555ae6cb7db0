"""Readers and writers: payload files, areas, lookups, fact tables, rollup snapshots."""
