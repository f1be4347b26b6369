"""Column functions on titles, names, lists and colours."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.config import COLOR_SYNONYMS, COLORS

#: Fixed value: the four signs that count as an apostrophe.
APOSTROPHES = "[‘’'`]"
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"
#: White space of any kind, the four separators of ASCII included.
BLANK = r"[\s\x1C-\x1F]"


#: Texts that are strings of Python at a time, of the many in an Arrow batch.
AT_ONCE = 256


@F.arrow_udf(T.StringType())
def strip_accents(values: pa.Array) -> pa.Array:
    """Compatibility-decomposed text without combining marks; null stays null."""

    def one(text):
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    parts = [pa.array(map(one, values.slice(i, AT_ONCE).to_pylist()), pa.string()) for i in range(0, len(values), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; ``F.trim`` knows the blank only."""
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def even(c: Column) -> Column:
    """White space made even and trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){BLANK}+", " "))


def normalize_text(c: Column) -> Column:
    """A title as it is compared: no accents, case, apostrophes, punctuation or leading article. Null gives ''."""
    plain = F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), APOSTROPHES, "")
    return F.regexp_replace(even(F.regexp_replace(plain, NOT_WORD, " ")), r"^(?:the|a|an) (?=.)", "")


def normalize_author(c: Column) -> Column:
    """struct(surname, initials) of a name in either order; null for blank names and those without a surname.

    With a comma, the surname is all before the first one; else it is the last word.
    """
    spaced = even(F.regexp_replace(strip_accents(c), r"\.(?=\S)", ". "))
    clean = lambda x: F.filter(F.split(even(F.regexp_replace(F.lower(x), NOT_WORD, " ")), " "), lambda w: w != "")
    comma = F.instr(spaced, ",")
    before, after = clean(F.substring(spaced, F.lit(1), comma - 1)), clean(F.substring(spaced, comma + 1, F.length(spaced)))
    words = clean(spaced)
    surname = F.when(comma > 0, F.array_join(before, " ")).otherwise(F.try_element_at(words, F.lit(-1)))
    given = F.when(comma > 0, after).otherwise(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    name = F.struct(surname.alias("surname"), F.transform(given, lambda w: F.substring(w, 1, 1)).alias("initials"))
    # The cast keeps the names of the fields where the optimiser would make them anew.
    return F.when(c.isNotNull() & (F.coalesce(surname, F.lit("")) != ""), name).cast("struct<surname:string,initials:array<string>>")


def split_pipe_list(c: Column) -> Column:
    """The non-empty, trimmed items of a list written with bars; empty and null give an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x != "")


def normalize_hex(c: Column) -> Column:
    """``#RRGGBB`` in capitals, or '' for anything that isn't six hex digits."""
    digits = F.regexp_replace(F.upper(strip(F.coalesce(c, F.lit("")))), "^#+", "")
    return F.when(digits.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), digits)).otherwise("")


def parse_year(c: Column, on_error: str = "raise") -> Column:
    """A year; blank gives null. A bad one raises, or gives null with ``on_error='null'``."""
    year = F.nullif(strip(c), F.lit(""))
    return year.try_cast("int") if on_error == "null" else year.cast("int")


def parse_flag(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)) == "true", F.lit(False))


def clean_color(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


#: The vocabulary's colour of every known word.
KNOWN = {c: c for c in COLORS} | COLOR_SYNONYMS


def color_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*KNOWN.items())])


def normalize_spine_color(c: Column) -> Column:
    """The vocabulary's colour for a description: the whole of it, or else its last word that is known; else null."""
    text, known = F.lower(strip(c)), color_map()
    words = F.transform(F.reverse(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))), lambda w: known[w])
    return F.coalesce(known[text], F.get(F.filter(words, lambda w: w.isNotNull()), F.lit(0)))


#: What counts as a word of a description.
WORD = re.compile("[a-z]+")


def known_color(text: str) -> str | None:
    text = text.strip().lower()
    return KNOWN.get(text) or next((KNOWN[w] for w in reversed(WORD.findall(text)) if w in KNOWN), None)


#: Few descriptions differ; only short ones are kept.
cached_color = lru_cache(4096)(known_color)


def spine_color(value) -> str | None:
    """``normalize_spine_color`` of one value in Python; what is no text gives null."""
    return None if type(value) is not str else cached_color(value) if len(value) <= 64 else known_color(value)
