"""Operators on tables of regions, lines, texts, masks and outputs."""
