"""Switching query templates and rewriting boolean queries before they run (survey Q16, Q17)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexer import TokenBuffer
from .parser import parse


@dataclass(frozen=True)
class Rewrite:
    """query_param: where the query is; config_param, alternative: the parameter that an advanced query sets, and to what."""

    query_param: str = "q"
    config_param: str | None = None
    alternative: str | None = None
    parse_query: bool = True


@dataclass(frozen=True)
class PreparedQuery:
    params: dict[str, str]
    is_complex: bool = False
    parsed_query: str | None = None
    errors: tuple[int, ...] = ()

    @property
    def error_codes(self) -> str:
        return ",".join(map(str, self.errors))


def preprocess(params: Mapping[str, str], rewrite: Rewrite) -> PreparedQuery:
    """Only with both config_param and alternative set does it change anything."""
    out = dict(params)
    query = out.get(rewrite.query_param)
    if not rewrite.config_param or rewrite.alternative is None or not (query or "").strip():
        return PreparedQuery(out)
    tokens = TokenBuffer(query)
    if not tokens.is_advanced:
        return PreparedQuery(out)
    out[rewrite.config_param] = rewrite.alternative
    if not (rewrite.parse_query and tokens.has_and):
        return PreparedQuery(out, True)
    parsed = parse(tokens)
    out[rewrite.query_param] = parsed.text
    return PreparedQuery(out, True, parsed.text, parsed.errors)


def canonical(query: Column) -> Column:
    """Struct (rendered, errors) of a column of queries, in Arrow batches."""

    @F.pandas_udf("rendered string, errors array<int>")
    def run(values: pd.Series) -> pd.DataFrame:
        done = [parse(v) for v in values]
        return pd.DataFrame({"rendered": [d.text for d in done], "errors": [list(d.errors) for d in done]})

    return run(query)
