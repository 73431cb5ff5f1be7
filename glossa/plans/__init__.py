"""Whole evaluations and the catalogue of queries."""
