"""Spark jobs for news classification: corpus, text, features, models, scoring, reports."""
