"""Carrier events as a stream."""
