"""Streaming: a monitoring log that grows by appended batches."""
