"""Quality classifier: a sparse rule ensemble over statistics of the description text.

Boosted trees on a bounded sample of labelled postings give candidate rules, the conjunctions along their paths. A
logistic regression with lasso penalty weighs the rules and drops most; the rest are compiled into one Column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.llm import boost
from jobstrata.llm.common import bound_batches, written

#: At most so many labelled postings are used for fitting; beyond, those with the smallest hash of their id.
MAX_LABELLED = 20_000
STATISTICS = (
    "chars", "words", "word_length", "longest_word", "symbols", "upper", "digits", "marks", "exclamations", "bars", "line_length",
    "new_words", "new_pairs", "same_as_last", "dup_lines", "no_letter_words",
)
_BYTES = {
    "symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "marks": b".,;:?!'\"()-", "exclamations": b"!", "bars": b"|",
}


def describe(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS; shares are per character, word, pair or line."""
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), max(1, len(text))
    share = {name: float(seen[list(of)].sum()) / chars for name, of in _BYTES.items()}
    pairs = list(zip(words, words[1:]))
    return [
        float(len(text)), float(n), sum(map(len, words)) / max(1, n), float(max(map(len, words), default=0)),
        *[share[k] for k in ("symbols", "upper", "digits", "marks", "exclamations", "bars")], len(text) / max(1, len(lines)),
        len(set(words)) / max(1, n), len(set(pairs)) / max(1, n - 1), sum(a == b for a, b in pairs) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)), sum(not any(map(str.isalpha, w)) for w in words) / max(1, n),
    ]


def statistics(jobs: DataFrame) -> DataFrame:
    """id and the statistics of every posting; null texts count as empty."""
    schema = ", ".join(["id " + jobs.schema["id"].dataType.simpleString(), *[f"{s} double" for s in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([describe(t or "") for t in batch.column("description_raw").to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c) for c in rows.T]], ["id", *STATISTICS])

    return bound_batches(jobs).select("id", "description_raw").mapInArrow(run, schema)


@dataclass(frozen=True)
class RuleEnsemble:
    """log-odds of good quality = ``intercept`` + the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]

    def column(self, prefix: str = "") -> Column:
        """The probability of good quality, from the statistics' columns."""
        total = F.lit(self.intercept)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for feature, at_most, threshold in tests:
                value = F.col(f"`{prefix}{STATISTICS[feature]}`")
                holds = holds & (value <= threshold if at_most else value > threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, tests in self.rules:
            total += weight * _holds(x, tests)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, tests: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for feature, at_most, threshold in tests:
        held &= (x[:, feature] <= threshold) == at_most
    return held


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept isn't penalised."""
    n, k = r.shape
    full = np.hstack([np.ones((n, 1)), r])
    size = 4.0 / (np.linalg.norm(full, 2) ** 2 / n)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -40, 40)))
        new = v - size * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.0005, max_rules: int = 400) -> RuleEnsemble:
    """Without rows of both classes the ensemble is the (smoothed) share of good ones."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return RuleEnsemble(bias, ())
    _, trees = boost.fit(x, y, trees=40, depth=3, least=max(5, len(y) // 500))
    rules: dict[bytes, tuple] = {}
    for tree in trees:
        for path in tree.paths():
            held = _holds(x, path)
            if 0 < held.sum() < len(x):
                key = min(np.packbits(held).tobytes(), np.packbits(~held).tobytes())  # rules that say the same count once
                if key not in rules or len(path) < len(rules[key]):
                    rules[key] = path
    chosen = list(rules.values())[:max_rules]
    if not chosen:
        return RuleEnsemble(bias, ())
    held = np.stack([_holds(x, p) for p in chosen], axis=1).astype(float)
    bias, weights = lasso_logistic(held, y, penalty)
    return RuleEnsemble(bias, tuple((float(w), p) for w, p in zip(weights, chosen) if w != 0))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> RuleEnsemble:
    """labels: id, quality (0 or 1, null ignored), from which only ids outside the held-out fold are used.

    The postings with the smallest hash of their id are the sample, so the same table gives the same ensemble.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).select("id", "quality").distinct()
    share = min(1.0, 1.5 * max_labelled / max(1, known.count()))
    place = F.xxhash64(F.col("id"), F.lit(17))
    drawn = known.filter(place.cast("double") <= -(2.0**63) + share * 2.0**64)
    rows = drawn.join(stats, "id").orderBy(place, "id", "quality", *STATISTICS).limit(max_labelled).toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float))


def score_quality(jobs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every posting.

    Input: jobs(id, description_raw), labels(id, quality); other columns are ignored. Null and empty texts are scored as
    empty; repeated rows are each scored; without labels every score is 0.5; an empty table gives no rows. Statistics
    are written to the shared folder once, since fitting and scoring both read them.
    """
    stats = written(statistics(jobs), "quality-statistics")
    score = fit(stats, labels, max_labelled).column()
    return stats.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(jobs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The postings, with all their columns, that the ensemble predicts to be good.

    The statistics are worked out once for fitting and once more beside the texts, which costs less than joining them.
    """
    score = fit(written(statistics(jobs), "quality-statistics"), labels, max_labelled).column("stat: ")
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema] + [f"`stat: {s}` double" for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([describe(t or "") for t in batch.column("description_raw").to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in rows.T]], [*batch.schema.names, *[f"stat: {s}" for s in STATISTICS]])

    good = bound_batches(jobs).mapInArrow(run, fields).filter(score >= 0.5)
    return good.select(*[f"`{c}`" for c in jobs.columns])
