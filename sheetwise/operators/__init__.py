"""Operators on tables of drawing records."""
