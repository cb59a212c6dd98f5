"""Readers of books, annotations and node snapshots, and their writers."""
