"""Operators on the relational instance, its reports and the repository catalogue."""
