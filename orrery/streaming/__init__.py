"""Continuous ingestion of triples. The tables are those of batch work; a stream only feeds them."""
