"""All queries of the reference's own operators."""

from __future__ import annotations

from . import reference_files, reference_intervals, reference_numbers, reference_text

_PARTS = (reference_files, reference_intervals, reference_text, reference_numbers)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
