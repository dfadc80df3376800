"""The registered queries and, for each, the same result in plain SQL."""
