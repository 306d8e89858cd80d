"""Whole lifecycles as compositions of operators."""
