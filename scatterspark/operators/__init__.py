"""Operators on point sets, trees, graphs and factors."""
