"""Reusable plan shapes, input views and the query registry."""
