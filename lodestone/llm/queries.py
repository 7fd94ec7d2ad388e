"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from . import balltree, gif, langid, mixing, ngrams, packing, simhash, substrings, suffixes, urls

_MODULES = (suffixes, simhash, balltree, gif, langid, ngrams, packing, substrings, urls, mixing)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERY.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
