"""Operators over tables: changes, constraints, effects, history and browsing."""
