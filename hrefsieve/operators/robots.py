"""Robots rules: from robots.txt documents to a verdict per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrefsieve.functions.encoding import quote_path, unquote
from hrefsieve.functions.text import decode_utf8, let, lines, strip
from hrefsieve.functions.urls import join_url, split_url
from hrefsieve.session import join_small

ALLOW_ALL, DENY_ALL, RULES = "allow_all", "deny_all", "rules"


def rule_path(value: Column) -> Column:
    """Path of an allow or disallow line as it is compared with pages."""
    return quote_path(let(split_url(value), lambda p: join_url(p)))


def rule_target(url: Column) -> Column:
    """The part of a page URL that rules are compared with; NULL if malformed."""
    target = quote_path(let(split_url(unquote(url)), lambda p: join_url(p, authority=False)))
    return F.when(target == "", F.lit("/")).otherwise(target)


def document_verdict(status: Column, body: Column) -> Column:
    """What a robots.txt answer says as a whole. An unreadable one denies."""
    readable = F.is_valid_utf8(body.cast("string"))
    return (
        F.when(status.isin(401, 403), DENY_ALL)
        .when(status.between(400, 499), ALLOW_ALL)
        .when(status.between(200, 299) & readable, RULES)
        .otherwise(DENY_ALL)
    )


def robots_lines(robots: DataFrame) -> DataFrame:
    """Numbered key-value lines and blank lines of texts (domain, text).

    Adds ``kind``: ``blank``, ``agent``, or ``rule`` for any line a group can hold.
    """
    numbered = robots.select("domain", F.posexplode(lines(F.col("text"))).alias("line_no", "raw"))
    content = strip(F.regexp_replace("raw", r"(?s)#.*\z", ""))
    keyed = numbered.select(
        "domain", "line_no", "raw",
        F.when(F.contains(content, F.lit(":")), F.lower(strip(F.substring_index(content, ":", 1)))).alias("key"),
        unquote(strip(F.regexp_extract(content, r"(?s)\A[^:]*:(.*)\z", 1))).alias("value"),
    )
    kind = (
        F.when(F.col("raw") == "", "blank")
        .when(F.col("key") == "user-agent", "agent")
        .when(F.col("key").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    return keyed.select("domain", "line_no", "key", "value", kind.alias("kind")).where(F.col("kind").isNotNull())


def robots_blocks(robots: DataFrame) -> DataFrame:
    """Lines with their ``block_id``. Agents in a row share one block; a blank line ends it."""
    in_file = Window.partitionBy("domain").orderBy("line_no")
    so_far = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(in_file), F.lit("")) != "agent")
    marker = F.when(F.col("kind").isin("agent", "blank"), F.col("kind"))
    return (
        robots_lines(robots)
        .withColumn("opens", opens.cast("int"))
        .withColumn("block_id", F.sum("opens").over(so_far))
        .withColumn("live", F.last(marker, ignorenulls=True).over(so_far) == "agent")
        .where(F.col("live") & (F.col("kind") != "blank"))
        .select("domain", "block_id", "line_no", "kind", "key", "value")
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per agent and rule of each block: (domain, block_id, agent, rule_no, allow, path)."""
    blocks = robots_blocks(robots)
    agents = blocks.where(F.col("kind") == "agent").select("domain", "block_id", F.col("value").alias("agent"))
    rules = blocks.where(F.col("key").isin("allow", "disallow")).select(
        "domain", "block_id", F.col("line_no").alias("rule_no"),
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        rule_path(F.col("value")).alias("path"),
    )
    return agents.join(rules, ["domain", "block_id"])


def domain_rules(robots: DataFrame, agent_token: str, longest_match: bool = False) -> DataFrame:
    """One row per document with the rules that bind the agent, in the order they are tried.

    ``rules`` is that of the first group naming the agent, else of the first ``*``
    group, else empty. It is as large as one robots.txt at most.
    """
    rule = F.when(
        F.col("key").isin("allow", "disallow"),
        F.struct(
            F.col("line_no").alias("rule_no"),
            ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
            rule_path(F.col("value")).alias("path"),
        ),
    )
    agents = F.collect_list(F.when(F.col("kind") == "agent", F.col("value")))
    grouped = (
        robots_blocks(robots)
        .groupBy("domain", "block_id")
        .agg(
            agents.alias("agents"),
            F.count_if(F.col("kind") == "rule").alias("n_rules"),
            F.array_sort(F.collect_list(rule)).alias("rules"),
        )
        .where(F.col("n_rules") > 0)
    )
    is_default = F.array_contains("agents", "*")
    named = ~is_default & F.exists("agents", lambda a: F.contains(F.lit(agent_token), F.lower(a)))
    block = F.col("block_id")
    chosen = grouped.groupBy("domain").agg(
        F.coalesce(
            F.min_by("rules", F.when(named, block)),
            F.min_by("rules", F.when(is_default, block)),
        ).alias("rules")
    )
    if longest_match:
        longest = lambda a, b: (
            F.when(F.length(a["path"]) != F.length(b["path"]), F.length(b["path"]) - F.length(a["path"]))
            .when(a["allow"] != b["allow"], F.when(a["allow"], -1).otherwise(1))
            .otherwise(a["rule_no"] - b["rule_no"])
        )
        chosen = chosen.withColumn("rules", F.array_sort("rules", longest))
    return chosen


def domain_verdicts(robots_docs: DataFrame, agent_token: str, longest_match: bool = False) -> DataFrame:
    """(domain, verdict, rules) from documents (domain, status, body)."""
    judged = robots_docs.select(
        "domain", decode_utf8(F.col("body")).alias("text"),
        document_verdict(F.col("status"), F.col("body")).alias("verdict"),
    )
    rules = domain_rules(judged.where(F.col("verdict") == RULES), agent_token, longest_match)
    return judged.select("domain", "verdict").join(rules, "domain", "left")


def verdict(url: Column) -> Column:
    """May the page be read, given the ``verdict`` and ``rules`` of its domain?"""
    target = rule_target(url)
    matching = let(target, lambda t: F.filter("rules", lambda r: (r["path"] == "*") | F.startswith(t, r["path"])))
    return (
        F.when(F.col("verdict") == ALLOW_ALL, True)
        .when(F.col("verdict") == RULES, F.coalesce(F.get(matching, F.lit(0))["allow"], F.lit(True)))
        .otherwise(False)
    )


def with_verdict(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add ``allowed`` to pages with a ``domain``. A domain without a document denies."""
    judged = join_small(pages, verdicts, "domain", "left")
    return judged.withColumn("allowed", verdict(F.col("url"))).drop("verdict", "rules")
