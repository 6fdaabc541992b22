"""Composed queries and the catalogue that registers them."""
