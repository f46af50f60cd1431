"""Runnable jobs over given paths. ``registry`` lists them as queries."""
