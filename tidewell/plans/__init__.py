"""Tidewell plans."""
