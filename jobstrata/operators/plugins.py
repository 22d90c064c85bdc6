"""Extractors written in Python, for facts the native heuristic cannot give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata import schemas
from jobstrata.session import bound_batches

Extractor = Callable[[dict], dict]
_INPUT = ["id", "title", "description_raw", "location", "remote_hint", "salary_min", "salary_max", "salary_currency"]
_FACTS = ["skills", "remote_policy", "salary_min", "salary_max", "salary_currency"]
_FOUND = T.StructType([f for f in schemas.JOBS.fields if f.name in ("id", *_FACTS)])


def in_steps(batch: pd.DataFrame, rows: int = 128) -> Iterator[pd.DataFrame]:
    """Parts of a batch, so that only their rows and results are Python objects at once."""
    return (batch.iloc[at : at + rows] for at in range(0, len(batch), rows))


def as_records(batch: pd.DataFrame) -> list[dict]:
    """Rows as dicts, with None for nulls of every type."""
    plain = batch.astype(object)
    return plain.where(plain.notna(), None).to_dict("records")


def as_frame(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    """Dicts as a frame Arrow can read with ``schema``; missing keys are null."""
    frame = pd.DataFrame(rows, columns=schema.fieldNames(), dtype=object)
    whole = [f.name for f in schema.fields if isinstance(f.dataType, T.IntegerType)]
    return frame.astype({name: "Int32" for name in whole})


def extract_with(postings: DataFrame, make_extractor: Callable[[], Extractor]) -> DataFrame:
    """(id, facts) for every posting the extractor can read; one it raises on is left out.

    ``make_extractor`` runs once per task, so clients and models are set up there. Pass only the
    postings that need it: ``ingest(..., extractor=...)`` hands over new and changed ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()
        for batch in batches:
            for part in in_steps(batch):
                found = []
                for row in as_records(part):
                    try:
                        found.append({**extract(row), "id": row["id"]})
                    except Exception:  # noqa: BLE001 - the heuristic takes this posting
                        continue
                yield as_frame(found, _FOUND)

    return bound_batches(postings).select(*_INPUT).mapInPandas(run, _FOUND).select("id", F.struct(*_FACTS).alias("facts"))
