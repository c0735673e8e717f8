"""Compositions of operators into whole curation steps."""
