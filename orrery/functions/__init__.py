"""Column functions and the closed vocabularies."""
