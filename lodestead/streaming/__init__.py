"""Continuous pickup of saved pages."""
