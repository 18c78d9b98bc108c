"""Readers and writers. Every reader returns DataFrames; nothing is inferred."""
