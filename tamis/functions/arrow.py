"""Arrow functions in query plans."""

from __future__ import annotations


def once(udf):
    """Keep the optimizer from copying a costly call into pushed-down filters."""
    return udf.asNondeterministic()
