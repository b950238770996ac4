"""Preparing texts for a translator: punctuation, digits, and parts that must come through unchanged."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# Zeros of the digit blocks, and the quote and dash forms that count alike.
ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0C66, 0x0CE6, 0x1C50, 0xABF0)
_DIGITS = {zero + d: str(d) for zero in ZEROS for d in range(10)}
_MARKS = str.maketrans({**dict.fromkeys("`´‘‚’", "'"), **dict.fromkeys("„“”«»", '"'), **dict.fromkeys("–—", "-"), "…": "...", "\r": None})

_SPACED = re.compile(r"\(\s+|\s+\)|\s[:;]\s?|\s+(?=[?!%])|(?<=\)) (?=[.!:?;,])")
_PROTECTED = re.compile(
    r"""(?P<mail>[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})
      | (?P<url>\b(?:(?:https?|ftp)://)?(?:[\w-]+\.)+[A-Za-z]{2,}(?:[/?\#][\w/?\#&=%.-]*)?)
      | (?P<number>~?\d+(?:[-/.,:']\d+)+\+?%?|\d+(?:\.\d+)?\s?%|\d{4,})
      | (?P<tag>[A-Za-z0-9]*[\#@]\w+)""",
    re.VERBOSE,
)
_PLACE = re.compile(r"[<\[]\s*id\s*(\d+)\s*[>\]]", re.IGNORECASE)


def tidy(text: str) -> str:
    """Plain quotes and dashes, no space inside brackets or before marks, ASCII digits, single spaces."""
    text = text.translate(_MARKS).translate(_DIGITS)
    text = _SPACED.sub(lambda m: m[0].strip(), text)
    return " ".join(re.sub(r'"([,.]+)', r'\1"', text).split())


def protect(text: str) -> tuple[str, list[str]]:
    """The text with ``<IDn>`` for addresses, links, figures and tags, and those parts in order."""
    parts: list[str] = []

    def hide(m: re.Match) -> str:
        if m.lastgroup == "number" and len(re.sub(r"[ .:]", "", m[0])) < 4 and "%" not in m[0]:
            return m[0]
        if m[0] not in parts:
            parts.append(m[0])
        return f"<ID{parts.index(m[0]) + 1}>"

    return _PROTECTED.sub(hide, tidy(text)), parts


def restore(text: str, parts: list[str]) -> str:
    """A translation with its parts back, however the translator spaced or bracketed their names."""
    return _PLACE.sub(lambda m: parts[int(m[1]) - 1] if 0 < int(m[1]) <= len(parts) else m[0], text)


@F.pandas_udf(StructType().add("text", StringType()).add("parts", ArrayType(StringType())))
def protected(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([protect(t or "") for t in texts], columns=["text", "parts"])


@F.pandas_udf(StringType())
def restored(texts: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else restore(t, list(p)) for t, p in zip(texts, parts, strict=True)])
