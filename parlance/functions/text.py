"""Text functions as column expressions.

Texts are expected in Unicode NFC; ``parlance.functions.transliterate.composed``
brings them there where that is not certain, and leaves the JVM only for rows
that need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that scoring ignores, the stop words, script blocks in order of precedence.
PUNCTUATION = r"""[।॥.,!?;:"'()\[\]{}<>\-–—…/\\|*#@%&+=~`^_]"""
STOP_WORDS = [
    "the", "and", "for", "with", "this", "that", "from", "are", "was", "has", "have", "not", "you", "your",
    "will", "about", "they", "them", "their", "there", "what", "which", "would", "been", "were", "into", "some", "then",
    "than", "also", "said", "says", "asks", "speaker", "speakers", "unspecified", "हाँ", "हां", "में", "है", "हैं", "और",
    "हम", "चाहिए", "नहीं", "तो", "का", "की", "के", "को", "से", "पर", "भी", "यह", "वह", "वो",
    "क्या", "कि", "ये", "था", "थे", "थी", "हो", "एक", "कर", "रहे", "रहा", "रही", "गया", "जी",
    "सर", "haan", "han", "hai", "hain", "mein", "aur", "hum", "chahiye", "nahi", "nahin", "kya", "yeh", "tha",
    "thi", "rahe", "raha", "rahi", "gaya", "sir",
]
SCRIPTS = (
    ("devanagari", r"[\x{0900}-\x{097F}]"), ("bengali", r"[\x{0980}-\x{09FF}]"), ("gurmukhi", r"[\x{0A00}-\x{0A7F}]"), ("gujarati", r"[\x{0A80}-\x{0AFF}]"), ("odia", r"[\x{0B00}-\x{0B7F}]"), ("tamil", r"[\x{0B80}-\x{0BFF}]"),
    ("telugu", r"[\x{0C00}-\x{0C7F}]"), ("kannada", r"[\x{0C80}-\x{0CFF}]"), ("malayalam", r"[\x{0D00}-\x{0D7F}]"), ("arabic", r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"), ("ol_chiki", r"[\x{1C50}-\x{1C7F}]"),
)
INDIC = r"[\x{0600}-\x{06FF}\x{0900}-\x{0D7F}\x{1C50}-\x{1C7F}]"
WORD = r"[\p{L}\p{N}_\x{0600}-\x{06FF}\x{0900}-\x{0D7F}\x{1C50}-\x{1C7F}]+"
TAGS = r"(?i)<[^>]*>|\[[^\]]*\]|\b(?:unintelligible|inaudible|noise)\b"
HEDGES = [
    "maybe ", "perhaps ", "probably ", "possibly ", "i think ", "i guess ", "i believe ", "we could ", "we might ",
    "we may ", "we should ", "should we ", "i could ", "i might ", "i want ", "i need ", "i wish ", "i would like ",
    "i'd like ",
]
QUESTION_STARTS = ("is ", "are ", "was ", "were ", "do ", "does ", "did ")
QUESTION_WORDS = r"\b(what|which|why|when|where|who|whom|how)\b"


def collapse(text: Column) -> Column:
    """Single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalise(text: Column) -> Column:
    """Scoring form: punctuation and dandas become spaces, lower case, single spaces."""
    return collapse(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, " ")))


def words(text: Column) -> Column:
    """The words of the scoring form."""
    form = normalise(text)
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.split(form, " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalise(text), F.lit(WORD), F.lit(0))


def content_of(items: Column) -> Column:
    """The tokens that carry content: three characters or more, and no stop word."""
    return F.filter(items, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def content_tokens(text: Column) -> Column:
    return content_of(tokens(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_repeats(items: Column) -> Column:
    """The items that differ from the one before them."""
    return bound(items, lambda own: F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))))


def ctc_collapse(ids: Column, blank: int) -> Column:
    """Greedy decoding of frame labels: repeats fall together, then blanks go."""
    return F.filter(without_repeats(ids), lambda x: x != blank)


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def sentence(text: Column) -> Column:
    """First letter upper case and one full stop at the end."""
    body = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.+$", "")
    return F.when(body == "", "").otherwise(F.concat(F.upper(F.left(body, F.lit(1))), F.substring(body, F.lit(2), F.length(body)), F.lit(".")))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def clean_tags(text: Column) -> Column:
    """Without annotation tags and the words that stand for unheard speech."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), TAGS, " "))


def english_form(text: Column) -> Column:
    form = F.lower(text)
    for british, american in (("colour", "color"), ("litre", "liter"), ("metre", "meter")):
        form = F.replace(form, F.lit(british), F.lit(american))
    return F.regexp_replace(form, "[^a-z]", "")


def bench_form(text: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"[\p{P}\p{S}]", " "))


def script_of(text: Column) -> Column:
    """The script with most characters; ties go to the earlier one, none gives null."""
    counts = F.array(
        *(
            F.struct(
                F.regexp_count(text, F.lit(block)).alias("n"),
                F.lit(-k).alias("order"),
                F.lit(name).alias("name"),
            ) for k, (name, block) in enumerate(SCRIPTS)
        )
    )
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["name"])


def estimated_tokens(text: Column) -> Column:
    """Half a token per Indic character, a third per other one, a tenth more, plus one."""
    indic = F.regexp_count(text, F.lit(INDIC))
    return (F.floor((indic / 2 + (F.length(text) - indic) / 3) * 1.1) + 1).cast("long")


def longest_translation(text: Column) -> Column:
    return (2 * F.length(text) + 30).cast("long")


def clock(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from an hour on; half seconds round to even."""
    total = F.rint(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes, rest = F.floor(total % 3600 / 60).cast("long"), total % 60
    hours = F.floor(total / 3600).cast("long")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))).otherwise(
        F.concat(two(minutes), F.lit(":"), two(rest))
    )


def srt_time(ms: Column) -> Column:
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(
        two(ms / 3600000),
        F.lit(":"),
        two(ms % 3600000 / 60000),
        F.lit(":"),
        two(ms % 60000 / 1000),
        F.lit(","),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def is_non_commitment(text: Column) -> Column:
    """Empty, an information question, or a hedged wish or suggestion."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    begins = lambda starts: F.rlike(low, F.lit("^(" + "|".join(starts) + ")"))
    question = F.endswith(low, F.lit("?")) & (F.rlike(low, F.lit(QUESTION_WORDS)) | begins(QUESTION_STARTS))
    return (low == "") | question | begins(HEDGES)


def json_object_text(reply: Column) -> Column:
    """The outermost braces of a reply without code fences; null where there are none."""
    body = F.regexp_replace(F.trim(reply), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def word_edits(ref: Column, hyp: Column, start: int = 0x3400) -> Column:
    """Levenshtein distance over words, exact and in the JVM.

    Each distinct word of the pair becomes one character, which the built-in
    distance then compares: code points from ``start`` on, without surrogates,
    so about a million distinct words fit one pair.
    """
    names = F.array_distinct(F.concat(ref, hyp))
    numbers = F.map_from_arrays(names, F.sequence(F.lit(1), F.size(names)))
    pair = F.struct(ref.alias("ref"), hyp.alias("hyp"), F.when(F.size(names) > 0, numbers).alias("numbers"))

    def distance(p: Column) -> Column:
        point = lambda w: F.lit(start) + F.element_at(p["numbers"], w)
        shown = lambda c: F.hex(F.when(c >= 0xD800, c + 0x800).otherwise(c))
        spell = lambda items: F.decode(F.unhex(F.array_join(F.transform(items, lambda w: F.lpad(shown(point(w)), 8, "0")), "")), "UTF-32")
        return F.levenshtein(spell(p["ref"]), spell(p["hyp"]))

    return bound(pair, distance).cast("long")
