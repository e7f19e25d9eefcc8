"""Readers, writers and generators of point sets and matrices."""
