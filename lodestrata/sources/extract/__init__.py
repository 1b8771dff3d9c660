"""Extractors: a file's text -> its facts, one nested row a file.  See :mod:`lodestrata.sources.extract.base`."""

from lodestrata.sources.extract.base import CLAIMS, FACTS, explode_facts, extract, parse_file

__all__ = ["CLAIMS", "FACTS", "explode_facts", "extract", "parse_file"]
