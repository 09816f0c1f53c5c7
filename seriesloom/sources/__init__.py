"""Declared inputs, typed reads and writes."""

from seriesloom.sources.spec import SourceSpec, coerce_types, load_sources, normalise_header, read_source, standardize_dates
from seriesloom.sources.store import load_model, save_model, write_table

__all__ = [
    "SourceSpec",
    "coerce_types",
    "load_model",
    "load_sources",
    "normalise_header",
    "read_source",
    "save_model",
    "standardize_dates",
    "write_table",
]
