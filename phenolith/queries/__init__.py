"""Registered queries, by part of the library."""
