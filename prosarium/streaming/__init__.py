"""Streaming forms of operators that need no more than a watermark."""
