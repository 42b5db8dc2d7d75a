"""Composite plans, and the tables that the registered queries derive from the given ones."""
