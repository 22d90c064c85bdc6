"""Language of a description: multinomial logistic regression on TF-IDF character n-grams, sparse by its penalties.

n-grams of 1 to 4 code points of the lower-cased text are hashed into ``BINS`` features. Document frequencies cover all
postings of the learning fold; the weights are trained on a bounded sample per language with follow-the-regularised-
leader (per-coordinate steps, L1 and L2). A temperature calibrates the score: it is fitted on short cut-outs of postings kept
aside, since on whole texts there are hardly any errors to learn it from, and is searched within ``TEMPERATURES``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.common import bound_batches
from jobstrata.llm.quality_classifier import held_out

BINS = 1 << 15
GRAMS = 4
PER_LANGUAGE = 300  # sampled postings of a language, a fifth of them for calibration
CUT_OUT = (6, 12, 24, 48)  # code points of the calibration texts, in turn
TEMPERATURES = (0.1, 20.0)
UNKNOWN = "und"
_CHUNK = 1 << 18


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the whole text's n-grams and 1 + log of their counts; long texts are hashed piece by piece."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    counts = np.zeros(BINS, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(codes), _CHUNK):
            part = codes[at:at + _CHUNK + GRAMS - 1]
            gram = np.zeros(len(part), np.uint64)
            for n in range(1, GRAMS + 1):
                gram = gram[:len(part) - n + 1] * np.uint64(1_000_003) + part[n - 1:]
                bins = ((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
                counts += np.bincount(bins[:_CHUNK].astype(np.int64), minlength=BINS)
    found = np.flatnonzero(counts)
    return found, 1 + np.log(counts[found])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def document_frequencies(jobs: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Postings in which each bin occurs, and postings of each language, over all given postings with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, languages = np.zeros(BINS, np.int64), {}
        for batch in batches:
            for language, text in zip(batch.column("language").to_pylist(), batch.column("description_raw").to_pylist()):
                languages[language] = languages.get(language, 0) + 1
                seen[features(text)[0]] += 1
        bins = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(seen[bins]), pa.nulls(len(bins), pa.string())], ["bin", "n", "language"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(languages), pa.int64()), pa.array(list(languages.values()), pa.int64()), pa.array(list(languages), pa.string())], ["bin", "n", "language"])

    rows = jobs.mapInArrow(count, "bin long, n long, language string").groupBy("bin", "language").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BINS)
    for r in rows:
        if r["bin"] is not None:
            seen[r["bin"]] = r["n"]
    return seen, {r["language"]: r["n"] for r in rows if r["language"] is not None}


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # bins by languages
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found, tf = features(text)
        return found, normed(tf * self.idf[found])

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found, x = self.vector(text)
        p = softmax((x @ self.weights[found] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def normed(x: np.ndarray) -> np.ndarray:
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bins by classes) and bias; the last pseudo-bin is the unpenalised bias."""
    z, n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == BINS, 0.0, l1)[:, None]
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            bins, x, label = rows[k]
            at, value = np.append(bins, BINS), np.append(x, 1.0)
            w = weights(at)
            slope = softmax(value @ w)
            slope[label] -= 1
            g = value[:, None] * slope
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(BINS + 1))
    return every[:BINS], every[BINS]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    (low, high), part = np.log(TEMPERATURES), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def cut_out(text: str, n: int) -> str:
    """A short piece of a text from a place that follows from the text, and its length from ``n``; around a letter if there is any."""
    size = CUT_OUT[n % len(CUT_OUT)]
    at = zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(text) - size + 1)
    if not has_letter(text[at:at + size]):
        at = next((k for k, c in enumerate(text) if c.isalpha()), 0)
    return text[at:at + size]


def fit_language(jobs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from postings outside the held-out fold that have a language and a letter in their text."""
    learn = bound_batches(jobs).filter(F.col("language").isNotNull() & F.col("description_raw").rlike(r"\p{L}") & ~held_out(F.col("id"))).select("id", "language", "description_raw")
    seen, counts = document_frequencies(learn)
    total = sum(counts.values())
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), idf, np.zeros((BINS, 0)), np.zeros(0), 1.0)
    place = F.xxhash64(F.col("id"), F.lit(23))
    # Some more than asked for are drawn by hash, then the first of each language are taken.
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 1.5 * per_language / n + 20 / n)))])
    drawn = learn.filter(place.cast("double") <= -(2.0**63) + share[F.col("language")] * 2.0**64)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("description_raw").to_pylist(), batch.column("place").to_pylist()
            cells = [(*features(t), *features(cut_out(t, p))) for t, p in zip(texts, places)]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float64())) * 2
            lists = [pa.array([c[k] for c in cells], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("language"), *lists], ["place", "language", "bins", "tf", "cut_bins", "cut_tf"])

    schema = "place long, language string, bins array<long>, tf array<double>, cut_bins array<long>, cut_tf array<double>"
    found = drawn.select(place.alias("place"), "language", "description_raw").mapInArrow(sample, schema).toPandas()
    found = found.assign(size=found["bins"].map(len)).sort_values(["place", "language", "size"], kind="stable").groupby("language", sort=True).head(per_language)

    def weighted(bins: str, tf: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
        return [(np.asarray(b, np.int64), normed(np.asarray(t) * idf[np.asarray(b, np.int64)]), languages.index(name)) for b, t, name in zip(found[bins], found[tf], found["language"])]

    train = [r for k, r in enumerate(weighted("bins", "tf")) if k % 5 != 4]
    check = [r for k, r in enumerate(weighted("cut_bins", "cut_tf")) if k % 5 == 4 and len(r[0])]
    weights, bias = train_ftrl(train, len(languages))
    logits = np.array([x @ weights[bins] + bias for bins, x, _ in check]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, np.array([label for *_, label in check], int)))


def identify(jobs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """id, held_out, language_pred and score of every posting.

    Input: id, description_raw, language (only the learning fold's is read); other columns are ignored. A null text or
    one without a letter is ``und`` with score 0, as is every text when nothing can be learned from. Repeated rows are
    each predicted; an empty table gives no rows.
    """
    model = fit_language(jobs, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("description_raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "held_out", "language_pred", "score"])

    id_type = jobs.schema["id"].dataType.simpleString()
    fold: Column = F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out")
    return jobs.select("id", fold, "description_raw").mapInArrow(run, f"id {id_type}, held_out boolean, language_pred string, score double")
