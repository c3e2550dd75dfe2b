"""Queries: operators bound to the tables of a folder."""
