"""Readers and writers: raw text, listings, manifests, the partitioned log table, CSV exports."""
