"""Structured-Streaming form of the bar import. The batch import is the model; this is an extension."""
