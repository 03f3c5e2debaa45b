"""Scoring streams (an extension)."""
