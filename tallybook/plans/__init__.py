"""The report queries: each takes a ``Star`` (or a report of one) and returns a DataFrame."""
