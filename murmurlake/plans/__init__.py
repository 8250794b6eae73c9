"""Graphs of transforms, and the registered queries."""
