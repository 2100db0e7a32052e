"""Scopes, ranges and the registered queries."""
