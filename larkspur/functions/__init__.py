"""Subpackage of larkspur."""
