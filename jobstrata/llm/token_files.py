"""Token files: the description texts as token ids, in id order, range-coded (see ``rans``).

Postings are range-partitioned by id, so partition k holds smaller ids than partition k + 1; each partition is written
as file images of about ``file_tokens`` tokens, one image per row of a Parquet table, through Spark's own committer: a
task that runs twice leaves one copy. Reading decodes images in parallel; only one total per partition is added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata.llm import rans
from jobstrata.llm.common import bound_batches
from jobstrata.llm.pieces import Pieces

END = 0
FILE_TOKENS = 1 << 21
_BATCH = 1 << 20  # characters encoded at a time


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _runs(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts of ``most`` characters or a little less; a longer one alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_postings(jobs: DataFrame, vocabulary: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """part, seq, tokens_before (in the part), tokens, ids, image: the file images in ascending id order.

    Input: id of any orderable type, description_raw (null: no tokens but ``end``). Repeated ids are ordered by text.
    """
    path = vocabulary or default_vocabulary()
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("description_raw", F.lit("")).alias("text")
    # Ties of an id must not be split: ranges are cut by id alone.
    ordered = bound_batches(jobs).select("id", text).repartitionByRange(parts, "id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("tokens_before", T.LongType()),
        T.StructField("tokens", T.LongType()), T.StructField("ids", T.ArrayType(jobs.schema["id"].dataType)), T.StructField("image", T.BinaryType()),
    ])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seq, before = _pieces(path), 0, 0, 0
        ids, counts, coded, size = [], [], [], 0

        def image() -> pa.RecordBatch:
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(ids_type)), pa.array([rans.encode(np.concatenate(coded), counts)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "tokens_before", "tokens", "ids", "image"])

        for batch in batches:
            ids_type = batch.column("id").type
            keys, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            part = batch.column("part")[0].as_py() if keys else part
            for a, b in _runs(texts, min(_BATCH, file_tokens)):
                found, own = pieces.encode(texts[a:b])
                coded.append(np.insert(found, np.cumsum(own), end))
                ids += keys[a:b]
                counts += (own + 1).tolist()
                size += len(coded[-1])
                if size >= file_tokens:
                    yield image()
                    before, seq = before + size, seq + 1
                    ids, counts, coded, size = [], [], [], 0
        if coded:
            yield image()

    return ordered.mapInArrow(write, schema)


def write_token_files(jobs: DataFrame, folder: str, vocabulary: str | None = None) -> None:
    encode_postings(jobs, vocabulary).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """id, start (tokens of all postings before it), n_tokens and ids_crc32 of each posting, from the files."""
    files = spark.read.parquet(folder)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("id", files.schema["ids"].dataType.elementType),
        T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image = rans.Image(batch.column("image")[k].as_py())
                tokens, ends = image.tokens().astype("<u4"), np.cumsum(image.counts)
                starts = ends - image.counts
                crcs = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), batch.column("part")[k].as_py()), pa.int32()), batch.column("ids")[k].values,
                        pa.array(starts + batch.column("tokens_before")[k].as_py()), pa.array(image.counts), pa.array(crcs, pa.int64()),
                    ],
                    ["part", "id", "at", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "tokens_before", "ids", "image").mapInArrow(read, schema)
    # One row per partition of the writer (its number is a setting), however large the index.
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return found.join(F.broadcast(offsets), "part").select("id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
