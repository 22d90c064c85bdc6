"""Skill tags: canonical forms, vocabulary extraction, lists and manifests."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions.text import WORD, strip


def empty_skills() -> Column:
    return F.array().cast("array<string>")


def or_empty(skills: Column) -> Column:
    """A null skill list reads as an empty one."""
    return F.coalesce(skills, empty_skills())


def lower_set(skills: Column) -> Column:
    return F.array_distinct(F.transform(or_empty(skills), F.lower))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(text) for pair in pairs.items() for text in pair])


def canonical_skill(tag: Column, aliases: dict[str, str] | None = None) -> Column:
    cleaned = F.lower(strip(tag))
    known = _literal_map(C.SKILL_ALIASES if aliases is None else aliases)
    return F.coalesce(F.try_element_at(known, cleaned), cleaned)


def canonical_skills(tags: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical tags without blanks or repeats, first occurrence first."""
    mapped = F.transform(or_empty(tags), lambda tag: canonical_skill(tag, aliases))
    return F.array_distinct(F.filter(mapped, lambda tag: tag != ""))


_ATOM = r"(?:[a-z0-9 #/-]|\\[^A-Za-z0-9])"
_SIMPLE = re.compile(rf"^(?:\\b)?{_ATOM}+(?:{_ATOM}\?|\[[^\]\[\\^]+\]\??|\([a-z0-9 /|-]+\)|{_ATOM})*(?:\\b)?$")


def _fixed_part(pattern: str) -> str:
    """The longest text every match of ``pattern`` must start with (word boundaries aside)."""
    text, rest = "", re.sub(r"^\\b|\\b$", "", pattern)
    while rest:
        char = rest[1] if rest[0] == "\\" else rest[0]
        width = 2 if rest[0] == "\\" else 1
        if rest[0] in "[(." or rest[width : width + 1] == "?":
            break
        text, rest = text + char, rest[width:]
    return text


def _bounded_pattern(pattern: str, fixed: str, word: str = WORD) -> str:
    """``pattern`` with Unicode word boundaries, tested after the fixed part has been found.

    Java's own ``\\b`` reads accented letters as boundaries; a look-behind in front of the text
    would be tried at every character.
    """
    begins, ends = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    body = pattern[2 if begins else 0 : len(pattern) - (2 if ends else 0)]
    head = re.escape(fixed).replace(r"\ ", " ")
    rest = body[len(fixed if body.startswith(fixed) else re.escape(fixed)) :]
    before = f"(?<![{word}]{head})" if begins else ""
    return head + before + rest + (f"(?![{word}])" if ends else "")


def _is_simple(pattern: str) -> bool:
    """Only patterns of literals, optional literals and plain classes are known to begin with a fixed text."""
    return bool(_SIMPLE.match(pattern) and _fixed_part(pattern))


def _simple_test(pattern: str) -> tuple[str, re.Pattern | None]:
    """The text to look for, and the expression that decides where it is found (None: being there decides)."""
    fixed = _fixed_part(pattern)
    if pattern in (re.escape(fixed), fixed, fixed + pattern[-2:-1] + "?"):
        return fixed, None
    return fixed, re.compile(_bounded_pattern(pattern, fixed, r"\w"))


_STEP = 256  # texts of a batch that are Python strings at once


def _found_simple(lowered: Column, patterns: list[str]) -> Column:
    """The numbers of the simple ``patterns`` that a text mentions. Python's search for a fixed text skips through it, where
    ``contains`` compares byte by byte, once per pattern."""
    tests = [_simple_test(pattern) for pattern in patterns]

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), _STEP):
            for text in texts.slice(at, _STEP).to_pylist():
                hits = None if text is None else [k for k, (fixed, rule) in enumerate(tests) if fixed in text and (rule is None or rule.search(text))]
                out.append(hits)
        return pa.array(out, pa.list_(pa.int32()))

    return found(lowered)


# ASCII without groups' flags or escapes that tell upper from lower case.
_CASELESS = re.compile(r"^(?!.*\(\?)(?:[\x20-\x5b\x5d-\x7e]|\\[^A-Za-z0-9]|\\[bdsw])*$")


def _matches(lowered: Column, pattern: str) -> Column:
    """Any other pattern is a regex on its own, whatever its case. In lower-case text only a dotless i equals an ASCII letter
    that it isn't; without one the pattern in lower case needs no folding, which is most of the work."""
    folded = lowered.rlike(f"(?iuU){pattern}")
    if not _CASELESS.match(pattern) or ("[" in pattern and pattern != pattern.lower()):
        return folded
    return F.when(F.contains(lowered, F.lit("ı")), folded).otherwise(lowered.rlike(f"(?U){pattern.lower()}"))


def lowered_text(text: Column) -> Column:
    """The text the vocabulary is matched on; keep it as a column, it is read once per pattern."""
    lowered = F.lower(text)
    return F.when(F.contains(lowered, F.lit("ſ")), F.replace(lowered, F.lit("ſ"), F.lit("s"))).otherwise(
        lowered
    )


def skills_in(
    lowered: Column,
    vocabulary: dict[str, list[str]] | None = None,
    limit: int = C.SKILL_LIMIT,
) -> Column:
    """Tags mentioned in a :func:`lowered_text`, in vocabulary order, the first ``limit`` of them."""
    vocabulary = C.SKILL_VOCABULARY if vocabulary is None else vocabulary
    simple = list(dict.fromkeys(p for patterns in vocabulary.values() for p in patterns if _is_simple(p)))
    found = _found_simple(lowered, simple) if simple else None

    def mentions(pattern: str) -> Column:
        return F.array_contains(found, simple.index(pattern)) if _is_simple(pattern) else _matches(lowered, pattern)

    tags = [F.when(reduce(lambda a, b: a | b, map(mentions, patterns)), F.lit(tag)) for tag, patterns in vocabulary.items()]
    return F.slice(F.array_compact(F.array(*tags)), 1, limit)


def parse_skill_list(text: Column) -> Column:
    """A comma-separated argument as tags; null or empty means no list."""
    parts = F.transform(F.split(text, ","), lambda part: F.lower(strip(part)))
    return F.when(text != "", F.filter(parts, lambda part: part != ""))


def is_auto_list(text: Column) -> Column:
    """True when the argument asks for the caller's own fingerprint skills."""
    return F.lower(strip(text)) == "auto"


def file_suffix(name: Column) -> Column:
    """Lower-cased last extension with its dot; '' for dot files and names without one."""
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def file_language(name: Column, languages: dict[str, str] | None = None) -> Column:
    known = _literal_map(C.EXTENSION_LANGUAGE if languages is None else languages)
    return F.try_element_at(known, file_suffix(name))


def manifest_skills(name: Column, text: Column) -> Column:
    """Tags a manifest or build file stands for, in the order of the dependency table."""
    lowered_name, lowered = F.lower(name), F.lower(F.coalesce(text, F.lit("")))
    listed = F.array(
        *[
            F.when(F.contains(lowered, F.lit(key)), F.lit(tag))
            for key, tag in C.DEPENDENCY_SKILL.items()
        ]
    )
    by_name = F.when(lowered_name == "dockerfile", F.array(F.lit("docker"))).when(
        file_suffix(name) == ".tf", F.array(F.lit("terraform"))
    )
    return F.coalesce(
        F.when(lowered_name.isin(C.MANIFEST_NAMES), F.array_distinct(F.array_compact(listed))),
        by_name,
        empty_skills(),
    )
