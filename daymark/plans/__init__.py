"""Whole jobs: sync, ingest, slices, snapshots."""
