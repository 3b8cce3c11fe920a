"""Composed flows (category-1/2 preprocessing, loads) and the registered queries."""
