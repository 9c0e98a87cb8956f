"""Column functions of the engine: cluster keys, literals, comparability."""
