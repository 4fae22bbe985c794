"""Helpers in Python for what the language leaves to rules."""
