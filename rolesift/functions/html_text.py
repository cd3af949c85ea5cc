"""HTML to text."""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolesift.functions.text import squeeze


def strip_html_basic(c: Column) -> Column:
    """Tags to spaces, the five common entities, numeric entities to spaces."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(F.regexp_replace(out, r"&#\d+;", " "))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _html.unescape(v))


# Not deterministic for the optimizer, so that a filter on the text does not decode twice.
_unescape = _unescape.asNondeterministic()


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(m: re.Match) -> str:
    return _html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1] + ";", m[0])


@F.pandas_udf(StringType())
def _unescape_closed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _CLOSED.sub(_closed, v))


_unescape_closed = _unescape_closed.asNondeterministic()


def strip_html_full(c: Column, closed_only: bool = False) -> Column:
    """Tags to spaces and every named or numeric entity decoded.

    HTML also reads some entities without their semicolon, as where a text was cut inside one;
    ``closed_only`` leaves these as they are.
    """
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    return squeeze((_unescape_closed if closed_only else _unescape)(text))


@F.pandas_udf(StringType())
def fold_nfkd(values: pd.Series) -> pd.Series:
    """Strict compatibility folding, for scripts beyond Latin Extended-A."""
    import unicodedata

    def fold(v):
        if v is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFKD", v)
                       if not unicodedata.combining(ch))
    return values.map(fold)
