"""URL filter for careers pages: a list of rules, and for hosts that no rule decides, trust spread over the link graph.

Trust starts at hosts with allowed pages and follows links (personalised PageRank); distrust starts at hosts with blocked
pages and follows links backwards: who links to blocked hosts is suspect. Edges are links between hosts, counted once per
page and target, and one from a host to its nearest parent domain that serves pages itself, as if it linked there: a
blocked domain makes its subdomains suspect, but one subdomain says nothing about its siblings. A host is blocked where
distrust exceeds ``ratio`` times trust.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobstrata.llm.common import written
from jobstrata.llm.decontaminate import LOWER, UPPER

DAMPING, ROUNDS, CUT_EVERY = 0.85, 8, 4
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``place`` is a host and a path, as ``example.org/es/``; the list is configuration, compiled into the plan."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return self.place[len(self.host):]


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of length, place and verdict; null if none does."""
    found = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path),
            F.struct(F.lit(len(r.place)).alias("length"), F.lit(r.place).alias("place"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    nothing = F.lit(None).cast("struct<length:int,place:string,verdict:string>")
    return F.greatest(nothing, nothing, *found)


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, and from a host to its nearest known parent."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("description_raw", F.lit(HREF), F.lit(1)))).alias("_link"))
    target = F.when(F.col("_link").startswith("//"), url_host(F.concat(F.lit("http:"), "_link"))).otherwise(url_host(F.col("_link")))
    linked = links.filter(F.col("_link").contains("//")).select(F.col("host").alias("src"), target.alias("dst"))
    linked = linked.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    labels = F.split("host", r"\.")
    parents = hosts.filter(F.col("host") != "").select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("_step", "_parent"))
    known = hosts.select(F.col("host").alias("_parent"))
    nearest = parents.filter(F.col("_parent") != "").join(known, "_parent").groupBy("host").agg(F.min_by("_parent", "_step").alias("parent"))
    return linked.union(nearest.select("host", "parent", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread_trust(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust of every host of ``seeds`` (host, trust, distrust) or ``edges``.

    One table of flows serves both directions, and a round is one join and one aggregate. A hub's rows are split by the
    join's own skew handling and summed before the shuffle. Rounds are cut by written tables.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("host")).union(seeds.select("host")).distinct()
    base = nodes.join(seeds, "host", "left").select("host", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("trust", "distrust")])
    base = written(base, "seeds")
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("_in"))
    shared = edges.join(out, "src").join(into, "dst")
    forward = shared.select(F.col("src").alias("host"), F.col("dst").alias("to"), (DAMPING * F.col("weight") / F.col("_out")).alias("t"), F.lit(0.0).alias("d"))
    backward = shared.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (DAMPING * F.col("weight") / F.col("_in")).alias("d"))
    flows = written(forward.union(backward), "flows")
    kept = base.select("host", ((1 - DAMPING) * F.col("trust")).alias("trust"), ((1 - DAMPING) * F.col("distrust")).alias("distrust"))
    ranks = base
    for k in range(1, rounds + 1):
        moved = ranks.join(flows, "host").select(F.col("to").alias("host"), (F.col("trust") * F.col("t")).alias("trust"), (F.col("distrust") * F.col("d")).alias("distrust"))
        ranks = kept.union(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % CUT_EVERY == 0:
            ranks = written(ranks, "ranks")
    return ranks.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[Rule], ratio: float = 1.0) -> DataFrame:
    """id, host, path, rule, trust, distrust and verdict (allow or block) of every page.

    Input: id, careers_url, description_raw (the page's markup, for its links); other columns are ignored. A null url and
    one without :// have an empty host and path, no rule, and are allowed; null markup has no links; repeated rows each
    count and are each returned; an empty table gives no rows. A host that neither trust nor distrust reaches is allowed.
    """
    host, path = url_host(F.col("careers_url")), url_path(F.col("careers_url"))
    placed = pages.select("id", host.alias("host"), path.alias("path"), "description_raw")
    judged = placed.select("id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("_rule"))
    counts = judged.groupBy("host").agg(
        F.count(F.when(F.col("_rule.verdict") == "allow", True)).cast("double").alias("trust"),
        F.count(F.when(F.col("_rule.verdict") == "block", True)).cast("double").alias("distrust"),
    )
    seeds = written(counts, "hosts")
    edges = written(host_edges(placed, seeds.select("host")), "host-edges")
    ranks = spread_trust(seeds, edges)
    # A page's own rule comes first; only pages without one wait for their host's rank.
    verdict = F.coalesce("_rule.verdict", F.when(F.col("distrust") > ratio * F.col("trust"), "block"), F.lit("allow"))
    return judged.join(ranks, "host", "left").select("id", "host", "path", F.col("_rule.place").alias("rule"), "trust", "distrust", verdict.alias("verdict"))
