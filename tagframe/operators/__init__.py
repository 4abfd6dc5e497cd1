"""Operators on tables of directories: parsing, lookups, image metadata."""
