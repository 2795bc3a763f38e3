"""Readers and writers: driver tables, canonical corpus, literal columns, score files."""
