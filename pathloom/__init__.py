"""Exact shortest paths on graphs whose weights change, and the analytics around them, on Spark."""
