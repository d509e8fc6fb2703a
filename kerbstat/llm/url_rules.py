"""URL rules by a sort-merge range join (native: built-in functions only).

A rule is a host and a path prefix with a verdict. Hosts are written label by label from the top
(``com.example.www``), and behind a separator comes the path: a rule's canonical key is then a prefix of
the keys it covers, that is, an interval in sort order, and two intervals are nested or apart.

A URL takes part with one key per suffix of its host, as a rule covers subdomains; only suffixes that are
some rule's host are kept. Rules and keys are merged in one sorted sweep per host: a window carries the
stack of rules that were active at the last rule passed, precomputed from the rules alone as the chain of
rules that enclose it. Of this stack, the rules that still enclose the key are those that fit the URL; the
longest wins, over all suffixes (length of host and path together; of equal ones the longer host).

Pages count once per distinct host and path. A host that many of them share is swept in parts of about
``PART`` keys, or as many as the host has rules if those are more, so that the rules copied to each part are
never more than the keys; a join on host and path, where Spark splits hot keys, takes verdicts back to the
pages. Rules are joined, not broadcast by hand.

Nulls and edge cases: a null URL, or one without ``://``, has an empty host and path, which no rule fits;
a null id is kept; repeated pages get a row each; empty tables of pages or rules are fine; rules with a
null host, path or verdict are left out, of repeated rules one counts (``allow`` before ``block``). Only
the id and the URL are read, so other columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbstat.llm.common import ascii_lower
from kerbstat.session import stage

#: Between the reversed host and the path; sorts before every character of either.
SEPARATOR = "\x00"
#: Keys of one host that are swept together.
PART = 1_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``(rhost, path, rule, verdict, size, stack)``; ``stack``: the rules that enclose it, itself last."""
    labelled = rules.where("host is not null and path is not null and verdict is not null").select(
        reversed_host(ascii_lower(F.col("host"))).alias("rhost"), "path", F.concat("host", "path").alias("rule"), "verdict"
    )
    one = labelled.groupBy("rhost", "path").agg(F.min(F.struct("verdict", "rule")).alias("_r")).select(
        "rhost", "path", "_r.rule", "_r.verdict"
    )
    one = stage(one, "rules")
    prefixes = one.select(
        "rhost", "path", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda n: F.left(F.col("path"), n))).alias("prefix")
    )
    enclosing = one.select("rhost", F.col("path").alias("prefix"), "rule", "verdict")
    entry = F.struct(F.char_length("prefix").alias("depth"), F.col("prefix").alias("path"), "rule", "verdict")
    return prefixes.join(enclosing, ["rhost", "prefix"]).groupBy("rhost", "path").agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url", part: int = PART
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page; ``default`` where no rule fits.

    ``rules`` has columns ``host``, ``path`` and ``verdict``.
    """
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    table = stage(canonical_rules(rules), "stacks")
    labels = table.select(F.size(F.split("rhost", r"\.")).alias("n")).agg(F.max("n")).first()[0] or 0
    distinct = parsed.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("_n")).drop("_n")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(labels))),
        lambda n: F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, n), "."),
    )
    hosts = table.groupBy("rhost").agg(F.count("*").alias("rules"))
    exploded = distinct.select("host", "path", F.explode(suffixes).alias("rhost")) if labels else None
    if exploded is None:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = stage(exploded.join(hosts, "rhost"), "keys")
    parts = keys.groupBy("rhost").agg(F.ceil(F.count("*") / F.greatest(F.lit(part), F.max("rules"))).cast("int").alias("parts"))
    no_stack = F.lit(None).cast(table.schema["stack"].dataType)
    dealt = keys.join(parts, "rhost").select(
        "rhost", F.pmod(F.xxhash64("host", "path"), "parts").cast("int").alias("part"), "path", "host", no_stack.alias("stack")
    )
    copied = table.join(parts, "rhost").select(
        "rhost", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "path", F.lit(None).cast("string").alias("host"), "stack"
    )
    canonical = F.concat("rhost", F.lit(SEPARATOR), "path")
    sweep = Window.partitionBy("rhost", "part").orderBy(canonical, F.col("host").isNotNull())
    swept = dealt.unionByName(copied).withColumn("_active", F.last("stack", ignorenulls=True).over(sweep))
    fits = F.filter("_active", lambda r: F.startswith(F.col("path"), r["path"]))
    chosen = F.try_element_at(fits, F.lit(-1))
    hits = swept.where(F.col("host").isNotNull()).where(F.size(fits) > 0).select(
        "host", "path",
        F.struct(
            F.char_length(chosen["rule"]).alias("size"), F.char_length("rhost").alias("host_size"),
            chosen["rule"].alias("rule"), chosen["verdict"].alias("verdict"),
        ).alias("hit"),
    )
    best = hits.groupBy("host", "path").agg(F.max("hit").alias("hit"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )
