"""Composite jobs: the public entry points of the library."""
