"""Small posting tables for the corpus operators."""

import datetime as dt

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("description_raw", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.DateType()),
])


def postings(spark, *rows):
    """Rows of (id, description_raw[, language[, source]]); ``text`` and ``n_words`` are columns that only clash by name."""
    filled = [(*r, *(None,) * (4 - len(r)), "other", dt.date(2024, 1, 1)) for r in rows]
    return spark.createDataFrame(filled, SCHEMA)


def documents(sf):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '/root/testdata/{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
