"""Readers: input lists and landed documents."""
