"""Tidewell operators."""
