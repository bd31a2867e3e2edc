"""Readers: saved pages, transit feeds, point files, preferences, edits."""
