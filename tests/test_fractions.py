import datetime as dt

from jobstrata.functions.text import parse_iso
from pyspark.sql import functions as F


def test_long_fractions_are_cut(spark):
    df = spark.createDataFrame([("2024-05-01T00:00:00.123456789Z",), ("2024-05-01 00:00:00,5",)], "t string")
    assert [r[0] for r in df.select(parse_iso(F.col("t"))).collect()] == [dt.datetime(2024, 5, 1, 0, 0, 0, 123456), dt.datetime(2024, 5, 1, 0, 0, 0, 500000)]
