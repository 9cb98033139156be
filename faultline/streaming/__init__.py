"""Merges fed by a stream."""
