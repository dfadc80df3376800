"""Readers and writers: text folders, graph transactions, stored tables."""
