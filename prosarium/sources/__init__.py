"""Readers and writers of the file formats around speech data."""
