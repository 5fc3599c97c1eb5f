"""Readers and writers for documents, triples, graphs and vector records."""
