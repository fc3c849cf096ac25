"""Glossa: short-form expansion analytics and corpus processing on Spark."""
