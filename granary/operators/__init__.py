"""Operators over relations: scans, checks, changes, relationships, nested columns."""
