"""Column expressions and ranking primitives shared by the operators."""
