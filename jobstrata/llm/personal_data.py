"""Personal data in descriptions: fixed rules, and candidates beyond them judged by boosted trees.

The rules find e-mail addresses, IPv4 addresses, card numbers and telephone numbers. Generators of high recall propose
further, overlapping spans: obfuscated addresses, other separators, numbers without a plus sign, and the parts of longer
runs of digits. Trees trained on format and context judge them.

There are no labels, so true spans of the other formats are made: each span that the rules accept is rewritten in its place in the
text (at and dot spelled out, other separators, no plus sign, no country code), and so keeps its surroundings. Fragments
of true spans, spans that reach beyond them, and what the rules reject are counter-examples. A candidate that no rule touches is
one only if its format (``shape``) is none of the true spans'; otherwise it may well be true, and is left out. Each kind has a
threshold, the lowest that keeps ``PRECISION`` on postings kept aside; a kind without enough examples adds nothing. Rule
spans always stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.llm import boost
from jobstrata.llm.common import bound_batches

KINDS = ("email", "ip", "card", "phone")
#: Trees are fitted on a bounded sample: at most so many postings with a digit or an at sign, those of least hash, at most so many
#: candidates of one posting, spread over its whole text, and of these the first so many in hash order.
MAX_POSTINGS = 4000
MAX_OF_POSTING = 200
MAX_CANDIDATES = 60_000
PRECISION = 0.98
MIN_EXAMPLES = 20
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits whose start failed, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def rule_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Accepted spans and matches that fail their check, per kind leftmost and without overlap, in code points."""
    good, bad = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            good.append((start, 0, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
            (good if fits else bad).append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = digits_of(m[0])
            (good if 14 <= len(digits) <= 19 and luhn(digits) else bad).append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            (good if 10 <= len(digits_of(m[0])) <= 15 else bad).append((m.start(), 3, m.end()))
    return sorted(good), sorted(bad)


_AT, _DOT = r"(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
_WIDE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}", re.I)
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[\x20().,\[\] –/_-]{0,3}")
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[\x20().,\[\] –/_-]{0,3}+[0-9])*+")


def candidates(text: str) -> list[Span]:
    """Proposed spans, overlapping ones included. Runs of digit groups propose each stretch of groups that has the number
    of digits of its kind; no kind has more than 19 digits, so there are at most 19 stretches per group and a long run costs in proportion."""
    found = {(m.start(), 0, m.end()) for m in _WIDE_EMAIL.finditer(text)}
    if not _DIGIT.search(text):
        return sorted(found)
    for run in _NUMBERS.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
        for i, (begin, _) in enumerate(groups):
            count, start = 0, begin
            while start > run.start() and text[start - 1] in "+(" and begin - start < 2:
                start -= 1
            for j in range(i, min(i + 19, len(groups))):
                count += groups[j][1] - groups[j][0]
                if count > 19:
                    break
                end = groups[j][1]
                if j - i == 3 and count <= 12 and all(b - a <= 3 and int(text[a:b]) <= 255 for a, b in groups[i:j + 1]):
                    found.add((begin, 1, end))
                if 13 <= count <= 19:
                    found.add((begin, 2, end))
                if 10 <= count <= 15:
                    found.add((start, 3, end))
    return sorted(found)


_HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact|@", r"\bip\b|host|server|addr", r"card|visa|iban|account|pay", r"tel|phone|call|fax|mobile|cell"))
_BEHIND, _AHEAD = re.compile(r"[0-9][\x20().,\[\] –/_+-]{0,4}$"), re.compile(r"[\x20().,\[\] –/_-]{0,3}[0-9]")
FEATURES = 26


def describe(text: str, span: Span) -> list[float]:
    """Format of the span and its surroundings."""
    start, kind, end = span
    own, before, after = text[start:end], text[max(0, start - 30):start], text[end:end + 30]
    groups = [len(g) for g in _GROUP.findall(own)] or [0]
    parts = [int(g) if len(g) < 5 else 9999 for g in _GROUP.findall(own)] or [0]
    digits = digits_of(own)
    gaps = [c for c in own if not c.isalnum()]
    return [
        *[float(kind == k) for k in range(4)], float(len(own)), float(len(digits)), float(len(groups)), float(max(groups)), float(min(groups)), float(max(parts)),
        float(luhn(digits)) if digits else 0.0, float(own[:1] == "+"), float("(" in own), float(own.count(".")), float(own.count("-")), float(own.count(" ")),
        float(len(set(gaps))), float(sum(c.isalpha() for c in own)), float("@" in own), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before[-1:] in (".", "-", "+", "(")) if before else 0.0, float(after[:1] in (".", "-", "@") and after[1:2].isalnum()), float(bool(_HINTS[kind].search(before))),
        float(bool(_BEHIND.search(before))), float(bool(_AHEAD.match(after))),
    ]


_ATS, _DOTS = (" [at] ", " (at) ", " at ", "[at]", "(at)", "{at}"), (" [dot] ", " (dot) ", " dot ", ".", "[dot]")


def rewrite(kind: int, own: str, n: int) -> str:
    """An accepted span in the n-th of its other formats."""
    if kind == 0:
        local, domain = own.rsplit("@", 1)
        return local + _ATS[n % len(_ATS)] + domain.replace(".", _DOTS[n // len(_ATS) % len(_DOTS)])
    digits = digits_of(own)
    if kind == 1:
        return own.replace(".", ("[.]", "(.)", " . ", ". ")[n % 4])
    if kind == 2:
        gap = (".", "/", "_", " - ", ", ")[n % 5]
        return gap.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    area, office, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    national = (f"({area}) {office}-{line}", f"{area}-{office}-{line}", f"{area}.{office}.{line}", f"{area} {office} {line}", f"{area}/{office}-{line}")
    forms = (*national, own[1:], *[f"{digits[:-10] or '1'}{gap}{national[1]}" for gap in "- ."])
    return forms[n % len(forms)]


def rewritten(text: str, good: list[Span]) -> tuple[str, list[Span]]:
    """The text with its accepted spans in other formats, and where they are now. Of overlapping ones the first is rewritten."""
    parts, spans, at, size = [], [], 0, 0
    for start, kind, end in good:
        if start < at:
            continue
        own = text[start:end]
        new = rewrite(kind, own, zlib.crc32(f"{start}:{own}".encode()))
        parts += [text[at:start], new]
        size += start - at
        spans.append((size, kind, size + len(new)))
        size, at = size + len(new), end
    return "".join([*parts, text[at:]]), spans


TRUE, FALSE, UNKNOWN = 1, 0, 2
_NAME = re.compile(r"[A-Za-z0-9_%+-]+")
_AGAIN = re.compile(rf"({_DOT}a)\1+")


def shape(kind: int, own: str) -> str:
    """The format of a span: its separators, and how many digits lie between them; the words of an address count as one each."""
    if kind == 0:
        return "0" + _AGAIN.sub(r"\1", _NAME.sub(lambda m: m[0].lower() if m[0].lower() in ("at", "dot") else "a", own))
    if kind == 1:
        return "1" + _GROUP.sub("9", own)
    return f"{kind}{luhn(digits_of(own)) if kind == 2 else ''}" + _DIGIT.sub("9", own)


def _labelled(text: str, true: list[Span], bad: list[Span]) -> Iterator[tuple[list[float], int, str]]:
    held, rejected = set(true), set(bad)
    for span in candidates(text):
        if span in held:
            label = TRUE
        elif span in rejected or any(t[0] < span[2] and span[0] < t[2] for t in true):
            label = FALSE
        else:
            label = UNKNOWN
        yield describe(text, span), label, shape(span[1], text[span[0]:span[2]])


def examples(text: str) -> list[tuple[list[float], int, str]]:
    """Candidates of the text as it is and with its accepted spans rewritten, as TRUE, FALSE or UNKNOWN, with their shapes."""
    good, bad = rule_spans(text)
    found = list(_labelled(text, good, bad))
    if good:
        # What is the same in both texts counts once: of the rewritten one only what is known.
        found += [e for e in _labelled(*rewritten(text, good), []) if e[1] != UNKNOWN]
    return found


@dataclass(frozen=True)
class SpanModel:
    start: float
    trees: tuple[boost.Tree, ...]
    thresholds: tuple[float, ...]

    def more(self, text: str, good: list[Span]) -> list[Span]:
        """Candidates above their threshold that overlap no rule span, the surest first where they overlap each other."""
        if not np.isfinite(self.thresholds).any():
            return []
        spans = [s for s in candidates(text) if np.isfinite(self.thresholds[s[1]]) and not any(g[0] < s[2] and s[0] < g[2] for g in good)]
        if not spans:
            return []
        odds = boost.log_odds(self.start, list(self.trees), np.array([describe(text, s) for s in spans]))
        chosen: list[Span] = []
        for k in sorted(range(len(spans)), key=lambda k: (-odds[k], spans[k][0] - spans[k][2], spans[k])):
            s = spans[k]
            if odds[k] >= self.thresholds[s[1]] and not any(c[0] < s[2] and s[0] < c[2] for c in chosen):
                chosen.append(s)
        return chosen


def calibrate(odds: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> tuple[float, ...]:
    """Per kind, from which log-odds on PRECISION holds: a quarter of the way below the lowest such value seen, towards
    the next lower one or 0, since nothing seen lies between. Infinite without enough true examples."""
    out = []
    for k in range(len(KINDS)):
        o, t = odds[kinds == k], y[kinds == k]
        best = np.inf
        if t.sum() >= MIN_EXAMPLES / 4:
            below = 0.0
            for cut in np.unique(o[o >= 0]):
                if t[o >= cut].mean() >= PRECISION:
                    best = float(cut - (cut - below) / 4)
                    break
                below = float(cut)
        out.append(best)
    return tuple(out)


def fit_spans(jobs: DataFrame, max_postings: int = MAX_POSTINGS) -> SpanModel:
    """Trees and thresholds from the candidates of a bounded sample of postings, the same for the same table."""
    some = bound_batches(jobs).filter(F.col("description_raw").rlike("[0-9@]"))
    place = F.xxhash64(F.col("id"), F.lit(31))
    total = some.count()
    share = min(1.0, 1.5 * max_postings / max(1, total))
    drawn = some.filter(place.cast("double") <= -(2.0**63) + share * 2.0**64).select(place.alias("place"), "description_raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, t in zip(batch.column("place").to_pylist(), batch.column("description_raw").to_pylist()):
                own = examples(t)
                step = -(-len(own) // MAX_OF_POSTING)
                rows += [(p, *e) for e in own[::step or 1]]
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["place", "x", "y", "shape"])

    found = drawn.mapInArrow(run, "place long, x array<double>, y int, shape string").orderBy("place", "x", "y", "shape").limit(MAX_CANDIDATES).toPandas()
    return fitted(found["place"].to_numpy(), np.array(found["x"].tolist()).reshape(-1, FEATURES), found["y"].to_numpy(), found["shape"].to_numpy())


def fitted(place: np.ndarray, x: np.ndarray, y: np.ndarray, shapes: np.ndarray) -> SpanModel:
    """A model of examples; those of a quarter of the postings, told by ``place``, are kept aside for the thresholds."""
    none = SpanModel(0.0, (), (np.inf,) * len(KINDS))
    if (y == TRUE).sum() < MIN_EXAMPLES or (y != TRUE).sum() < MIN_EXAMPLES:
        return none
    aside = (place % 4) == 0
    if not aside.any() or aside.all():
        return none
    known = (y != UNKNOWN) | ~np.isin(shapes, np.unique(shapes[y == TRUE]))
    x, t, aside = x[known], (y[known] == TRUE).astype(float), aside[known]
    start, trees = boost.fit(x[~aside], t[~aside], trees=40, depth=4, least=5)
    return SpanModel(start, tuple(trees), calibrate(boost.log_odds(start, trees, x[aside]), t[aside], x[aside, :4].argmax(axis=1)))


def find_personal_data(jobs: DataFrame, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """id, rule_spans and spans (rule spans and those added): arrays of start, kind, end in code points, by start and kind.

    Input: id, description_raw; other columns are ignored. Null and empty texts have no spans; repeated rows are each
    returned; an empty table gives no rows.
    """
    model = fit_spans(jobs, max_postings)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def named(spans: list[Span]) -> list[dict]:
        return [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules, every = [], []
            for text in batch.column("description_raw").to_pylist():
                good = rule_spans(text)[0] if text else []
                rules.append(named(good))
                every.append(named(good + model.more(text, good)) if text else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rules, kind), pa.array(every, kind)], ["id", "rule_spans", "spans"])

    struct = "array<struct<start:int,kind:string,end:int>>"
    return jobs.select("id", "description_raw").mapInArrow(run, f"id {jobs.schema['id'].dataType.simpleString()}, rule_spans {struct}, spans {struct}")


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
