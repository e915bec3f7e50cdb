"""Readers and keyed writers."""
