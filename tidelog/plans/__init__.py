"""Registered queries by theme, each with its SQL."""
