"""Readers, writers and the logical shop tables."""
