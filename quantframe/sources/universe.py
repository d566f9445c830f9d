"""Symbol universes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.sources.specs import RESEARCH_SYMBOLS


def parse_symbols(text: str | None, default: Sequence[str] = RESEARCH_SYMBOLS) -> list[str]:
    """Comma-separated symbols in upper case; the default when none is named."""
    named = [part.strip().upper() for part in (text or "").split(",")]
    return [symbol for symbol in named if symbol] or list(default)


def filter_universe(df: DataFrame, symbols: Sequence[str] | DataFrame, column: str = "symbol") -> DataFrame:
    """Rows of the universe. A list becomes a pushed-down filter, a table a semi join."""
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select(column), column, "left_semi")
    return df.filter(F.col(column).isin(list(symbols)))
