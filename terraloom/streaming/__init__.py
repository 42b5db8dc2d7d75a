"""Operators over event logs and sequences."""
