"""Operators for preparing large text and record collections."""
