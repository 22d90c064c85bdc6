"""Literal rows in the index schemas."""

import datetime as dt

from jobstrata import schemas
from jobstrata.functions.text import content_hash
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 6, 1, 12, 0, tzinfo=dt.timezone.utc)


def days_ago(n: float) -> dt.datetime:
    return NOW - dt.timedelta(days=n)


def table(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)


def jobs(spark, *rows):
    base = {
        "company_id": "acme", "title": "Engineer", "description_raw": "text", "skills": [], "remote_policy": "unknown",
        "salary_inferred": False, "first_seen_at": days_ago(10), "verified_at": days_ago(1), "relist_count": 0,
        "ghost_score": 0.0, "source": "ats_public_api", "apply_channel": "https://jobs.lever.co/acme/1",
        "extraction_source": "heuristic", "skills_fallback": [],
    }
    filled = table(spark, schemas.JOBS, [{**base, **r} for r in rows])
    return filled.withColumn(
        "content_hash", F.coalesce("content_hash", content_hash(F.col("title"), F.col("description_raw")))
    )


def feed(spark, *rows):
    base = {"company_id": "acme", "title": "Engineer", "description_raw": "text", "apply_channel": "https://x/1"}
    return table(spark, schemas.FEED, [{**base, "feed_pos": i, **r} for i, r in enumerate(rows)])


def companies(spark, *ids):
    rows = [
        {"id": i, "name": i.title(), "ats_vendor": "lever", "ats_tenant": i, "verified": False, "last_crawled_at": None} for i in ids
    ]
    return table(spark, schemas.COMPANIES, rows)


def crawls(spark, **ok):
    return table(
        spark, schemas.CRAWLS,
        [{"company_id": c, "ok": v, "status": 200 if v else 404, "error": None if v else "non-200"} for c, v in ok.items()],
    )


def by_id(df, key="id"):
    return {row[key]: row for row in df.collect()}


def explain(df) -> str:
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )
