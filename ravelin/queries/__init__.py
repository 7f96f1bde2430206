"""Registered queries of the linkage engine, each with its SQL where SQL can express it."""
