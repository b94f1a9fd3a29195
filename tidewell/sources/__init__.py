"""Tidewell sources."""
