"""Joins whose probe side is a stream."""
