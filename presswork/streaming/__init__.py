"""Scoring over streams of new texts."""
