"""The language catalogue and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name, script, Latin name, whether a CTC model exists.
CATALOGUE = [
    ("as", "Assamese", "bengali", "Assamese (Latin)", False), ("bn", "Bengali", "bengali", "Benglish", True), ("brx", "Bodo", "devanagari", "Bodo (Latin)", False), ("doi", "Dogri", "devanagari", "Dogri (Latin)", False),
    ("gu", "Gujarati", "gujarati", "Gujlish", True), ("hi", "Hindi", "devanagari", "Hinglish", True), ("kn", "Kannada", "kannada", "Kanglish", False), ("ks", "Kashmiri", "arabic", "Kashmiri (Latin)", False),
    ("kok", "Konkani", "devanagari", "Konkani (Latin)", False), ("mai", "Maithili", "devanagari", "Maithili (Latin)", False), ("ml", "Malayalam", "malayalam", "Manglish", False), ("mni", "Manipuri", "bengali", "Manipuri (Latin)", False),
    ("mr", "Marathi", "devanagari", "Marathi (Latin)", False), ("ne", "Nepali", "devanagari", "Nepali (Latin)", False), ("or", "Odia", "odia", "Odia (Latin)", True), ("pa", "Punjabi", "gurmukhi", "Punglish", False),
    ("sa", "Sanskrit", "devanagari", "Sanskrit (Latin)", False), ("sat", "Santali", "ol_chiki", "Santali (Latin)", False), ("sd", "Sindhi", "arabic", "Sindhi (Latin)", False), ("ta", "Tamil", "tamil", "Tanglish", False),
    ("te", "Telugu", "telugu", "Teluglish", False), ("ur", "Urdu", "arabic", "Roman Urdu", False),
]
ALIASES = {"bangla": "bn", "gujrati": "gu", "hinglish": "hi", "gom": "kok", "meitei": "mni", "oriya": "or", "panjabi": "pa"}


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "code string, name string, script string, latin_name string, has_ctc boolean")


def language_code(name: Column) -> Column:
    """The code for a code, name or alias in any case; empty or null means Hindi, unknown gives null."""
    known = {c: c for c, *_ in CATALOGUE} | {n.lower(): c for c, n, *_ in CATALOGUE} | ALIASES
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.when(low == "", "hi").otherwise(F.element_at(table, low))


def resolve_language(name: str | None) -> tuple:
    """The catalogue row of a language; unknown names raise."""
    low = (name or "").strip().lower() or "hi"
    code = ALIASES.get(low, low)
    for row in CATALOGUE:
        if code in (row[0], row[1].lower()):
            return row
    raise ValueError(f"Unknown language: {name}")
