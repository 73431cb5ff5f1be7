"""Operators for large text corpora: one module an operator, `queries` registers them."""
