"""Column helpers and distributed primitives shared by the operators."""
