"""Column builders: strings, sets, distances."""
