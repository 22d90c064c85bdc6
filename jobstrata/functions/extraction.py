"""Facts derived from one posting: the native heuristic and the cleaning of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions import pay as P
from jobstrata.functions.remote import resolve_remote
from jobstrata.functions.skills import canonical_skills, lowered_text, or_empty, skills_in
from jobstrata.functions.text import strip

FACTS = (
    "struct<skills:array<string>,remote_policy:string,"
    "salary_min:int,salary_max:int,salary_currency:string>"
)


def facts(skills: Column, remote_policy: Column, amounts: Column) -> Column:
    return F.struct(
        skills.alias("skills"),
        remote_policy.alias("remote_policy"),
        amounts["min"].alias("salary_min"),
        amounts["max"].alias("salary_max"),
        amounts["currency"].alias("salary_currency"),
    )


def with_heuristic_facts(
    df: DataFrame,
    only: Column | None = None,
    vocabulary: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Adds the struct column ``facts``: skills and remote policy from the text of a posting, pay
    from the vendor's fields, else from the text.

    Rows where ``only`` does not hold get null, and their text is never read. The text and its
    lower-case form are columns of their own, so that each is built once per row although dozens
    of patterns read it.
    """
    chosen = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    title, description = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "description_raw"))
    df = df.withColumns(
        {
            "_chosen": chosen,
            "_text": F.when(chosen, F.concat_ws("\n", title, description)),
        }
    ).withColumn("_lowered", lowered_text(F.col("_text")))
    stated = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    df = df.withColumn("_pay_text", F.when(F.col("_chosen") & ~stated, description)).withColumn(
        "_text_pay", P.pay_from_text(F.col("_pay_text"))
    )
    amounts = F.when(
        stated, P.pay(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"))
    ).otherwise(F.col("_text_pay"))
    found = facts(
        skills_in(F.col("_lowered"), vocabulary),
        resolve_remote(F.col("remote_hint"), F.col("location"), F.col("_text")),
        amounts,
    )
    return df.withColumn("facts", F.when(F.col("_chosen"), found)).drop(
        "_chosen", "_text", "_lowered", "_pay_text", "_text_pay"
    )


_REPLY = (
    "skills array<string>, remote_policy string, "
    "salary_min int, salary_max int, salary_currency string"
)


def clean_reply(
    reply: Column, salary_min: Column, salary_max: Column, salary_currency: Column
) -> Column:
    """A model's JSON reply as facts; null when it is no JSON object.

    Vendor pay wins field by field. A remote policy outside the enumeration reads as unknown.
    """
    data = F.from_json(reply, _REPLY)
    readable = F.get_json_object(reply, "$").startswith("{")
    blank_free = F.filter(or_empty(data["skills"]), lambda s: s.isNotNull() & (strip(s) != ""))
    remote = F.when(data["remote_policy"].isin(C.REMOTE_POLICIES), data["remote_policy"])
    currency = F.when(salary_currency != "", salary_currency)
    cleaned = facts(
        F.slice(canonical_skills(blank_free), 1, C.SKILL_LIMIT),
        F.coalesce(remote, F.lit("unknown")),
        P.pay(
            F.coalesce(salary_min, data["salary_min"]),
            F.coalesce(salary_max, data["salary_max"]),
            F.coalesce(currency, data["salary_currency"]),
        ),
    )
    return F.when(readable, cleaned)


def clamp_role_family(label: Column) -> Column:
    cleaned = F.lower(strip(F.coalesce(label, F.lit("other"))))
    return F.when(cleaned.isin(C.ROLE_FAMILIES), cleaned).otherwise(F.lit("other"))
