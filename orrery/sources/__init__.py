"""Readers and writers of triples, payloads, runs and results."""
