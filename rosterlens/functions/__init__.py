"""Column builders and small helpers shared by the operators."""
