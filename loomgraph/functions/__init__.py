"""Column and frame functions that operators are composed of."""
