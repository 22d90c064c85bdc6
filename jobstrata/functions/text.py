"""Text normalisation, hashing, markup and date parsing as Column expressions."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode word characters, spelled out because Java's \\w is ASCII by default.
WORD = r"\p{L}\p{N}_"
# White space up to U+00FF, character by character: Java tests such a list by one table look-up,
# but every range or property in it by a chain of calls. The wider blanks are mapped to it first.
_ODD = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
SPACE = " " + _ODD
WIDE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PERHAPS_WIDE = r"[\u1680\u2000-\u206f\u3000]"
_BEYOND = r"[^\x00-\xff]"  # a table look-up for each character, unlike the list of ranges
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column, characters: str = SPACES) -> Column:
    return F.btrim(text, F.lit(characters))


def plain_spaces(text: Column) -> Column:
    """White space beyond U+00FF as single blanks; pass a column, it is read several times."""
    perhaps = text.rlike(_BEYOND) & text.rlike(_PERHAPS_WIDE)
    return F.when(perhaps, F.regexp_replace(text, f"[{WIDE}]", " ")).otherwise(text)


def collapse(text: Column, odd: str = _ODD) -> Column:
    """Every run of blanks and ``odd`` characters as one blank. Single blanks, by far the most
    frequent, are left alone. One class begins the pattern: two alternatives would both be tried at every character."""
    return F.regexp_replace(text, f"[ {odd}](?:[ {odd}]+|(?<! ))", " ")


def normalize_text(text: Column) -> Column:
    """Lower case, every run of white space one blank, no outer blanks; null becomes ''."""
    return F.trim(collapse(F.lower(F.coalesce(plain_spaces(text), F.lit("")))))


def normalize_title(title: Column) -> Column:
    """As :func:`normalize_text`, with punctuation read as blanks."""
    words = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), f"[^{WORD}]+", " ")
    return F.trim(words)


def content_hash(title: Column, description: Column) -> Column:
    return F.sha2(F.concat_ws("\n", normalize_text(title), normalize_text(description)), 256)


@F.pandas_udf(StringType())
def _unescape_all(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


# The entities that nearly all markup uses; '&' last so that one pass stays one pass.
BASIC_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": "\xa0",
    "&amp;": "&",
}
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)[#A-Za-z]"


def _replace_all(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), pairs.items(), text
    )


def unescape_basic(text: Column) -> Column:
    """The basic entities only; for markup that uses no others."""
    return F.when(F.contains(text, F.lit("&")), _replace_all(text, BASIC_ENTITIES)).otherwise(text)


def unescape(text: Column) -> Column:
    """All HTML entities. Only texts with a rare entity travel to Python; the rest stays native."""
    rare = F.when(F.contains(text, F.lit("&")) & text.rlike(_OTHER_ENTITY), text)
    return F.coalesce(_unescape_all(rare), unescape_basic(text))


# --- Fixed values: tags that become line breaks or bullets ----------------------
_BLOCK_TAGS = {"</p>": "\n\n", "<(?:br(?: ?/)?|/li)>": "\n", "<li>": "• "}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as column ``name``, worked out once a row however often it is read. Behind a plain projection the optimizer
    would put the expression in place of every reading; it does not look through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_plain_text(df: DataFrame, markup: str, out: str, decode=unescape) -> DataFrame:
    """Adds ``out``: entity-encoded or plain HTML of column ``markup`` as readable text, '' for null."""
    tagless = F.col("_decoded")
    for tag, shown in {**_BLOCK_TAGS, "<[^>]+>": ""}.items():
        tagless = F.regexp_replace(tagless, tag, shown)
    tagless = F.when(F.contains("_decoded", F.lit("<")), tagless).otherwise(F.col("_decoded"))
    shown = collapse(F.col("_shown"), r"\t\r\x0c\x0b")
    df = _once(df.withColumn("_markup", F.coalesce(F.col(markup), F.lit(""))), "_decoded", decode(F.col("_markup")))
    df = _once(df, "_tagless", tagless)
    df = _once(df, "_shown", decode(F.col("_tagless")))
    return df.withColumn(out, strip(F.regexp_replace(shown, r"\n\n\n+", "\n\n"))).drop("_markup", "_decoded", "_tagless", "_shown")


_ISO = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
    r"(?:Z|[+-]\d{2}:?\d{2})?)?$"
)


def parse_iso(text: Column) -> Column:
    """ISO date or date-time, with or without offset (none means UTC); anything else is null."""
    shaped = F.when(text.rlike(_ISO), F.regexp_replace(F.regexp_replace(text, ",", "."), r"(\.\d{6})\d+", "$1"))
    return shaped.try_cast("timestamp")


def parse_epoch_ms(value: Column) -> Column:
    """Milliseconds since 1970 as a number or digits; 0 and anything unreadable are null."""
    millis = F.nullif(value.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.timestamp_millis(millis)


def prompt_text(title: Column, location: Column, description: Column, cap: int = 4000) -> Column:
    """The text an external model reads for one posting."""
    place = F.when(location != "", location).otherwise(F.lit("n/a"))
    return F.concat(
        F.lit("Title: "), title,
        F.lit("\nLocation: "), F.coalesce(place, F.lit("n/a")),
        F.lit("\n\nDescription:\n"), F.substring(F.coalesce(description, F.lit("")), 1, cap),
    )


def key_points(text: Column, count: int = 3, width: int = 100, shortest: int = 25) -> Column:
    """The first readable lines of a description, without bullets, cut at ``width``."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    lines = F.transform(lines, lambda line: F.btrim(line, F.lit(" •-\t")))
    lines = F.filter(lines, lambda line: F.char_length(line) >= shortest)
    return F.transform(
        F.slice(lines, 1, count),
        lambda line: F.when(
            F.char_length(line) > width, F.concat(F.substring(line, 1, width), F.lit("…"))
        ).otherwise(line),
    )
