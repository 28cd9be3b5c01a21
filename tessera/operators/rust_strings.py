"""Emptying of Rust string literals, which no built-in expression can do exactly."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A raw string, one without an end, a character (or lifetime), and a string; the first that fits is taken.
LITERAL = r"""(?P<open>b?r(?P<h>\#*)")(?s:.*?)(?P<shut>"(?P=h))|(?P<rest>b?r\#*"(?s:.*))|(?P<char>'(?:\\(?:u\{[^}]*\}?|(?s:.))?|[^\\])?'?)|"(?:\\(?s:.)|[^"\\])*(?:"|\\?\Z)"""


def _emptied(m: re.Match) -> str:
    if m["open"] is not None:
        return f"{m['open']} {m['shut']}"
    return m["rest"] or m["char"] or '""'


def stripper() -> Callable[[str], str]:
    """Function that empties the string literals of a source.

    Raw strings keep one space, other strings nothing between their quotes;
    characters, lifetimes and comments stay. A raw string without an end stays
    as it is, another string without one is closed.
    """
    literal = re.compile(LITERAL)
    return lambda source: literal.sub(_emptied, source)


def stripped() -> Callable[[Column | str], Column]:
    """The same as a column function, in Arrow batches; its code travels by value."""
    pattern = LITERAL

    @F.pandas_udf("string")
    def strip(sources: pd.Series) -> pd.Series:
        literal = re.compile(pattern)

        def emptied(m: re.Match) -> str:
            if m["open"] is not None:
                return f"{m['open']} {m['shut']}"
            return m["rest"] or m["char"] or '""'

        return sources.map(lambda source: literal.sub(emptied, source), na_action="ignore")

    return strip


#: The same for DuckDB, whose patterns know no back references: raw strings with up to one mark, and no space is kept.
STRIP_SQL = r"""regexp_replace({content}, '(b?r")[^"]*(")|(b?r#")(?s:.*?)("#)|(b?r#*"(?s:.*))|(''(?:\\(?:u\{{[^}}]*\}}?|(?s:.))?|[^\\])?''?)|(")(?:\\(?s:.)|[^"\\])*("|\\?$)', '\1\2\3\4\5\6\7\8', 'g')"""


def strip_sql(content: str) -> str:
    return STRIP_SQL.format(content=content)
