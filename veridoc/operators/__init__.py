"""Operators on the tables of a knowledge graph."""
