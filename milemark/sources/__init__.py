"""Readers, writers, table loads and the snapshot store."""
