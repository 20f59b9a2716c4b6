"""Databases, their storage, and links to other sources."""
