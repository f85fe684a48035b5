"""Readers and writers: case tables, raw CSV, text index, models."""
