"""Queries: each operator applied to the star-schema tables, with an independent SQL form where SQL can express it."""
