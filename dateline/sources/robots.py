"""Robots files to allow/deny rules, one row per host and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.schemas import ROBOTS_RULE

_RULES = f"array<{ROBOTS_RULE.simpleString()}>"


def _directives(txt: Column) -> Column:
    """Lines as ``u:agent``, ``a:path`` or ``d:path``; comments and the rest dropped."""
    lines = F.transform(
        F.split(txt, r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, "#.*$", ""))
    )
    coded = F.transform(
        lines,
        lambda line: F.concat(
            F.lower(F.regexp_extract(line, r"^(?i)\s*(u(?=ser-?agent)|a(?=llow)|d(?=isallow))", 1)),
            F.lit(":"),
            F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)),
        ),
    )
    return F.filter(coded, lambda c: c.rlike("^(?:u|[ad]:.)") | c.rlike("^[ad]:$"))


def _rule(line: Column) -> Column:
    pattern = F.substr(line, F.lit(3))
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^?|])", r"\\$1")
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substr(quoted, F.lit(1), F.length(quoted) - 1)).otherwise(quoted)
    body = F.replace(F.replace(body, F.lit("$"), F.lit(r"\$")), F.lit("*"), F.lit(".*"))
    return F.struct(
        line.startswith("a").alias("allow"),
        pattern.alias("pattern"),
        (pattern.contains("*") | anchored).alias("wild"),
        F.concat(F.lit("^"), body, F.when(anchored, F.lit("$")).otherwise(F.lit(""))).alias("regex"),
    )


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``(host, txt)`` to ``(host, rules)`` for one crawler name.

    Groups naming the crawler's product token are merged; without one the ``*`` groups
    count; without either nothing is forbidden. Rules are ordered by precedence:
    longer pattern first, allow before deny. Hosts whose text is null are left out.
    """
    token = agent.split("/")[0].strip().lower()
    text = F.concat(F.array_join(_directives(F.col("txt")), "\n"), F.lit("\n"))
    # A group: its agent lines, then its rule lines.
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)((?:^u:.*\n)+(?:^[ad]:.*\n)*)"), F.lit(1))
    groups = F.transform(
        blocks,
        lambda block: F.struct(
            F.transform(
                F.filter(F.split(block, "\n"), lambda x: x.startswith("u:")),
                lambda x: F.lower(F.trim(F.regexp_extract(x, r"^u:([^/]*)", 1))),
            ).alias("agents"),
            F.filter(F.split(block, "\n"), lambda x: x.rlike("^[ad]:.")).alias("lines"),
        ),
    )
    own = F.filter("groups", lambda g: F.array_contains(g["agents"], token))
    anyone = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    chosen = F.when(F.size(own) > 0, own).otherwise(anyone)
    rules = F.transform(F.flatten(F.transform(chosen, lambda g: g["lines"])), _rule)
    ranked = F.array_sort(
        rules,
        lambda a, b: F.when(F.length(a["pattern"]) != F.length(b["pattern"]),
                            F.length(b["pattern"]) - F.length(a["pattern"]))
        .when(a["allow"] == b["allow"], 0)
        .when(a["allow"], -1)
        .otherwise(1),
    )
    return (
        robots.where("txt is not null")
        .withColumn("groups", groups)
        .select("host", ranked.cast(_RULES).alias("rules"))
    )


def allowed(url: Column, rules: Column) -> Column:
    """Verdict of the first fitting rule; null rules forbid, no fitting rule allows."""
    target = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    fitting = F.filter(
        rules,
        lambda r: F.when(r["wild"], F.regexp_like(target, r["regex"])).otherwise(
            F.startswith(target, r["pattern"])
        ),
    )
    verdict = F.coalesce(F.get(fitting, 0)["allow"], F.lit(True))
    return F.when(rules.isNull(), False).when(target == "/robots.txt", True).otherwise(verdict)
