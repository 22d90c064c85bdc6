"""Re-extraction with an external model: outcomes, budget, merge, comparison and rollback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata import schemas
from jobstrata.functions import scoring
from jobstrata.functions.extraction import clamp_role_family
from jobstrata.functions.skills import or_empty
from jobstrata.operators.plugins import as_frame, as_records, in_steps
from jobstrata.operators.predicates import pending_extraction, pending_family
from jobstrata.operators.scans import running_totals
from jobstrata.session import bound_batches

VALUES = ["skills", "remote_policy", "salary_min", "salary_max", "salary_currency"]

# --- calling a model --------------------------------------------------------------

Model = Callable[[dict], dict]


def collect_outcomes(
    postings: DataFrame, make_model: Callable[[], Model], attempts: int = 3, parallel: int = 1, pause: float = 0.0
) -> DataFrame:
    """One outcome per posting: facts and tokens, or the last error after ``attempts`` tries.

    ``make_model`` runs once per task and returns a function from a posting (as a dict) to a dict
    with the facts, ``prompt_tokens`` and ``completion_tokens``. It may raise; nothing is lost.
    Each task keeps up to ``parallel`` calls open; before try k + 1 it waits ``pause`` * 2^(k - 1) seconds.
    Write the result to a table before merging it, so that no reply is paid for twice.
    """

    failed = {"skills": [], "remote_policy": "unknown", "prompt_tokens": 0, "completion_tokens": 0}
    return _collected(postings, make_model, attempts, parallel, pause, failed, schemas.OUTCOMES)


def collect_family_outcomes(
    postings: DataFrame, make_model: Callable[[], Model], attempts: int = 3, parallel: int = 1, pause: float = 0.0
) -> DataFrame:
    """As :func:`collect_outcomes`, for replies with a ``role_family``, which is clamped to the known ones."""
    failed = {"role_family": None, "prompt_tokens": 0, "completion_tokens": 0}
    found = _collected(postings, make_model, attempts, parallel, pause, failed, schemas.FAMILY_OUTCOMES)
    return found.withColumn("role_family", F.when(F.col("ok"), clamp_role_family(F.col("role_family"))))


def _collected(postings: DataFrame, make_model, attempts: int, parallel: int, pause: float, failed: dict, schema) -> DataFrame:
    def ask(model: Model, posting: dict) -> dict:
        error = None
        for tried in range(attempts):
            if tried and pause:
                time.sleep(pause * 2 ** (tried - 1))
            try:
                return {**model(posting), "job_id": posting["id"], "ok": True, "error": None}
            except Exception as failure:  # noqa: BLE001 - recorded in the outcome
                error = f"{type(failure).__name__}: {failure}"
        return {**failed, "job_id": posting["id"], "ok": False, "error": error}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        with ThreadPoolExecutor(max(1, parallel)) as calls:
            for batch in batches:
                for part in in_steps(batch, max(128, parallel)):
                    yield as_frame(list(calls.map(lambda row: ask(model, row), as_records(part))), schema)

    wanted = postings.select("id", "title", "description_raw", "location")
    return bound_batches(wanted).mapInPandas(run, schema)


def with_fallback(model_facts: Column, heuristic: Column) -> Column:
    """A model's facts, or the heuristic's where the model failed."""
    return F.coalesce(model_facts, heuristic)


# --- merging ----------------------------------------------------------------------


def _merged(prefix: str = "reply") -> dict[str, Column]:
    """Skills are the model's; policy and pay only where the index has none."""
    reply = {name: F.col(f"{prefix}.{name}") for name in VALUES}
    no_policy = F.coalesce("remote_policy", F.lit("")).isin("", "unknown")
    paid = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    return {
        "skills": or_empty(reply["skills"]),
        "remote_policy": F.when(no_policy, reply["remote_policy"]).otherwise(F.col("remote_policy")),
        **{
            name: F.when(paid, F.col(name)).otherwise(reply[name])
            for name in ("salary_min", "salary_max", "salary_currency")
        },
    }


def merged_values(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What each successful outcome would write, next to the current values (``old``)."""
    replies = outcomes.filter("ok").select(F.col("job_id").alias("id"), F.struct(*VALUES).alias("reply"))
    return jobs.join(replies, "id").select(
        "id", "company_id", "title", F.struct(*VALUES).alias("old"),
        *[value.alias(name) for name, value in _merged().items()],
    )


def _kept_fallback(target: str) -> dict[str, Column]:
    """The current values kept aside, once: only while none are and another source wrote them."""
    keep = F.coalesce(F.col("extraction_source") != target, F.lit(True)) & (
        F.size(or_empty(F.col("skills_fallback"))) == 0
    )
    now = {name: or_empty(F.col(name)) if name == "skills" else F.col(name) for name in VALUES}
    return {
        f"{name}_fallback": F.when(keep, now[name]).otherwise(F.col(f"{name}_fallback")) for name in VALUES
    }


def keep_fallback(jobs: DataFrame, target: str = C.TARGET_SOURCE) -> DataFrame:
    return jobs.withColumns(_kept_fallback(target))


def _budgeted(
    pending: DataFrame, outcomes: DataFrame, batch_size: int, limit: int | None, ceiling: float
) -> DataFrame:
    """Pending ids in batches by id, with the cost before their batch; over ``limit`` is cut."""
    costs = outcomes.select(
        F.col("job_id").alias("id"), "ok",
        F.coalesce("prompt_tokens", F.lit(0)).cast("bigint").alias("tokens_in"),
        F.coalesce("completion_tokens", F.lit(0)).cast("bigint").alias("tokens_out"),
    )
    ranked = running_totals(
        pending.select("id").join(costs, "id"), ["id"], {"through_in": "tokens_in", "through_out": "tokens_out"}
    )
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    numbered = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / batch_size))
    # Token totals only grow, so the first batch whose end passes the ceiling is the last one run.
    reached = scoring.token_cost(F.col("through_in"), F.col("through_out")) >= ceiling
    last = numbered.filter(reached).agg(F.min("batch"))
    return numbered.withColumn("last_batch", last.scalar()).withColumn(
        "done", F.col("last_batch").isNull() | (F.col("batch") <= F.col("last_batch"))
    )


def cost_ceiling(
    jobs: DataFrame,
    outcomes: DataFrame,
    batch_size: int = 50,
    limit: int | None = None,
    ceiling: float = C.COST_CEILING,
    target: str = C.TARGET_SOURCE,
) -> DataFrame:
    """Which pending postings a run within the ceiling gets to: id, ok, tokens, batch, done."""
    return _budgeted(jobs.filter(pending_extraction(target)), outcomes, batch_size, limit, ceiling)


def rebuild_extraction(
    jobs: DataFrame,
    outcomes: DataFrame,
    batch_size: int = 50,
    limit: int | None = None,
    ceiling: float = C.COST_CEILING,
    target: str = C.TARGET_SOURCE,
) -> DataFrame:
    """The index after one run. Failed and unreached postings keep what they have and stay pending;
    each pending posting is tried once per run."""
    done = cost_ceiling(jobs, outcomes, batch_size, limit, ceiling, target).filter("done AND ok")
    replies = outcomes.join(done.select(F.col("id").alias("job_id")), "job_id", "left_semi").select(
        F.col("job_id").alias("id"), F.struct(*VALUES).alias("reply")
    )
    joined = jobs.join(replies, "id", "left")
    hit = F.col("reply").isNotNull()
    new = {**_kept_fallback(target), **_merged(), "salary_inferred": F.lit(False), "extraction_source": F.lit(target)}
    return joined.select(
        *[
            (F.when(hit, new[name]).otherwise(F.col(name)) if name in new else F.col(name)).alias(name)
            for name in jobs.columns
        ]
    )


def label_role_family(
    jobs: DataFrame,
    outcomes: DataFrame,
    batch_size: int = 100,
    limit: int | None = None,
    ceiling: float = C.COST_CEILING,
) -> DataFrame:
    """The index with families for the unlabelled postings a run within the ceiling gets to."""
    reached = _budgeted(jobs.filter(pending_family()), outcomes, batch_size, limit, ceiling)
    labels = outcomes.join(
        reached.filter("done AND ok").select(F.col("id").alias("job_id")), "job_id", "left_semi"
    ).select(F.col("job_id").alias("id"), clamp_role_family(F.col("role_family")).alias("_label"))
    return (
        jobs.join(labels, "id", "left")
        .withColumn("role_family", F.coalesce("role_family", "_label"))
        .select(jobs.columns)
    )


def rebuild_stats(
    jobs: DataFrame,
    outcomes: DataFrame,
    batch_size: int = 50,
    limit: int | None = None,
    ceiling: float = C.COST_CEILING,
    target: str = C.TARGET_SOURCE,
) -> DataFrame:
    """Counters of one run in one row."""
    pending = jobs.filter(pending_extraction(target))
    reached = _budgeted(pending, outcomes, batch_size, limit, ceiling)
    counts = reached.filter("done").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("ok").alias("updated"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("completion_tokens"),
    )
    cost = scoring.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return counts.select(
        pending.agg(F.count(F.lit(1))).scalar().alias("total_target"), "*", cost.alias("cost"),
        (cost >= ceiling).alias("halted"),
    )


def rollback_extraction(jobs: DataFrame, target: str = C.TARGET_SOURCE) -> DataFrame:
    """Values kept aside put back on the rows of ``target``; the copies stay where they are."""
    hit = F.coalesce(F.col("extraction_source") == target, F.lit(False))
    back = {
        name: or_empty(F.col("skills_fallback")) if name == "skills" else F.col(f"{name}_fallback")
        for name in VALUES
    }
    back["extraction_source"] = F.lit(C.HEURISTIC_SOURCE)
    return jobs.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in back.items()})


# --- comparison -------------------------------------------------------------------


def sample_rows(jobs: DataFrame, count: int, salt: str | None = None) -> DataFrame:
    """``count`` random postings; with a salt the same ones every time."""
    order = F.rand() if salt is None else F.md5(F.concat("id", F.lit(salt)))
    return jobs.orderBy(order).limit(count)


def compared(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per successful outcome, how the merged values differ from the current ones."""
    old, new = F.array_distinct(or_empty(F.col("old.skills"))), F.array_distinct(F.col("skills"))
    gained, lost = F.size(F.array_except(new, old)), F.size(F.array_except(old, new))
    paid_before, paid_now = F.col("old.salary_max").isNotNull(), F.col("salary_max").isNotNull()
    moved = ~F.equal_null("old.remote_policy", "remote_policy")
    return merged_values(jobs, outcomes).select(
        "id", "company_id", F.substring("title", 1, 48).alias("title"),
        F.array_sort(old).alias("heuristic_skills"), F.array_sort(new).alias("model_skills"),
        F.col("old.remote_policy").alias("heuristic_remote"), F.col("remote_policy").alias("model_remote"),
        moved.alias("remote_changed"),
        (paid_now & ~paid_before).alias("salary_added"),
        (paid_before & ~paid_now).alias("salary_removed"),
        ((gained == 0) & (lost > 0)).alias("narrower"),
        (gained > 0).alias("broader"),
        ((F.size(old) > 0) & (F.size(new) == 0)).alias("emptied"),
        ((gained + lost > 0) | moved).alias("differs"),
    )


def comparison_report(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Model against heuristic in one row."""
    flags = ["remote_changed", "salary_added", "salary_removed", "narrower", "broader", "emptied"]
    rows = compared(jobs, outcomes).agg(F.struct(
        F.coalesce(F.avg(F.size("heuristic_skills")), F.lit(0.0)).alias("heuristic_skill_avg"),
        F.coalesce(F.avg(F.size("model_skills")), F.lit(0.0)).alias("model_skill_avg"),
        *[F.count_if(flag).alias(flag) for flag in flags],
    ).alias("all"))
    known = outcomes.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    tokens = known.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    )
    cost = scoring.token_cost(F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost")
    return tokens.withColumn("_rows", rows.scalar()).select(*tokens.columns, cost, "_rows.*")


def comparison_examples(jobs: DataFrame, outcomes: DataFrame, count: int = 12) -> DataFrame:
    return compared(jobs, outcomes).filter("differs").orderBy("id").limit(count)


def extrapolated_cost(report: DataFrame, total_jobs: Column, ceiling: float = C.COST_CEILING) -> DataFrame:
    """A comparison's cost per success, scaled to ``total_jobs``; 0 when nothing succeeded."""
    total = F.when(F.col("ok") == 0, F.lit(0.0)).otherwise(F.col("cost") / F.col("ok") * total_jobs)
    return report.select(total.alias("estimate"), (total > ceiling).alias("over_ceiling"))
