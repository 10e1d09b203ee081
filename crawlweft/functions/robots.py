"""robots.txt, meta robots and X-Robots-Tag. Groups follow RFC 9309: an agent line after a rule begins a new group."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FILE = "rules array<struct<agent:string,kind:string,rule:string,pattern:string>>, delays array<struct<agent:string,seconds:double>>, sitemaps array<string>, host string"
DIRECTIVES = ("noindex", "nofollow", "noarchive", "nosnippet", "noimageindex", "notranslate")


def pattern_of(rule: str) -> str:
    """`*` stands for anything, a last `$` for the end; a rule holds from the path's beginning."""
    body = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$"))
    return f"^{body}{'$' if rule.endswith('$') else ''}"


def file_of(text: str | None) -> dict:
    out, agents, fresh = {"rules": [], "delays": [], "sitemaps": [], "host": ""}, [], True
    for line in (text or "").splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        match key:
            case "user-agent":
                agents = [*(agents if fresh else []), value.lower()]
                fresh = True
            case "allow" | "disallow":
                fresh = False
                # a group without a path is a group still: it keeps its agents from falling back to another
                out["rules"] += [{"agent": a, "kind": key, "rule": value, "pattern": pattern_of(value)} for a in agents]
            case "crawl-delay":
                fresh = False
                if re.fullmatch(r"\d+(\.\d*)?|\.\d+", value):
                    out["delays"] += [{"agent": a, "seconds": float(value)} for a in agents]
            case "sitemap":
                out["sitemaps"].append(value)
            case "host":
                out["host"] = value
    return out


def rules_of(text: str) -> list[tuple[str, str, str, str]]:
    """(agent, kind allow or disallow, path, regular expression) of a robots.txt."""
    return [tuple(r.values()) for r in file_of(text)["rules"] if r["rule"]]


def _files(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([file_of(t) for t in text], columns=["rules", "delays", "sitemaps", "host"])


def parsed_robots(text: Column | str) -> Column:
    """A robots.txt as a struct of FILE."""
    return F.pandas_udf(_files, FILE)(text)


def for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """Of rules (host, agent, ...) those of each host that hold for an agent: of its own name, else of a name within it or around it (the first by name), else of `*`."""
    name = agent.lower()
    near = (F.col("agent") != "*") & (F.contains(F.lit(name), F.col("agent")) | F.contains(F.col("agent"), F.lit(name)))
    rank = F.when(F.col("agent") == name, 0).when(near, 1).when(F.col("agent") == "*", 2)
    best = rules.where(rank.isNotNull()).groupBy("host").agg(F.min(F.struct(rank.alias("rank"), "agent"))["agent"].alias("chosen"))
    return rules.join(best.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & (F.col("agent") == F.col("chosen"))).drop("_host", "chosen")


def allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths: host, path, any other columns; rules: host, kind, rule, pattern of one agent. Adds allowed to every row: longest match wins, ties allow."""
    keys = paths.select("host", "path").distinct()
    hit = keys.join(rules.where("rule <> ''"), "host").where(F.expr("regexp_like(CASE WHEN path = '' THEN '/' ELSE path END, pattern)"))
    best = hit.groupBy("host", "path").agg(F.max(F.when(F.col("kind") == "allow", F.octet_length("rule"))).alias("a"), F.max(F.when(F.col("kind") == "disallow", F.octet_length("rule"))).alias("d"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), (F.coalesce("a", F.lit(0)) >= F.coalesce("d", F.lit(0))).alias("allowed"))
    out = paths.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("_h", "_p")


def meta_robots(content: Column) -> Column:
    """Token-exact directives of a robots meta value, with its limits (-1 and '' where unset)."""
    tokens = F.transform(F.split(F.lower(F.coalesce(content, F.lit(""))), ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    none = F.array_contains(tokens, "none")
    has = lambda t: F.array_contains(tokens, t) | (none if t in ("noindex", "nofollow") else F.lit(False))

    def last(key: str, value: str) -> Column:
        found = F.filter(tokens, lambda t: F.regexp_like(t, F.lit(f"^{key}:{value}$")))
        return F.substring_index(F.element_at(found, -1), ":", -1)

    number = lambda key: F.coalesce(F.when(F.exists(tokens, lambda t: F.regexp_like(t, F.lit(f"^{key}:[+-]?[0-9]{{1,9}}$"))), last(key, "[+-]?[0-9]{1,9}").cast("int")), F.lit(-1))
    image = F.when(F.exists(tokens, lambda t: F.startswith(t, F.lit("max-image-preview:"))), last("max-image-preview", ".*")).otherwise(F.lit(""))
    return F.struct(*(has(d).alias(d) for d in DIRECTIVES), number("max-snippet").alias("max_snippet"), image.alias("max_image_preview"), number("max-video-preview").alias("max_video_preview"))


def x_robots(values: Column, agent: str) -> Column:
    """What X-Robots-Tag values (array<string>) say to an agent: of its own name, else of a name within it (the first by name), else the values without a name, of which noindex and nofollow add up. Null where none does."""
    name = agent.lower()
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    split = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lower(trim(F.substring_index(trim(v), ":", 1))).alias("who"), trim(v).alias("all")))
    named = lambda s: F.contains(s["all"], F.lit(":")) & ~F.contains(s["who"], F.lit(" ")) & ~F.startswith(s["who"], F.lit("max-"))
    own = F.filter(split, lambda s: named(s) & (s["who"] == name))
    near = F.array_sort(F.filter(split, lambda s: named(s) & F.contains(F.lit(name), s["who"])))
    plain = F.filter(split, lambda s: ~named(s))
    text = lambda s: F.substr(s["all"], F.instr(s["all"], ":") + 1)
    joined = F.concat_ws(",", F.get(plain, F.lit(0))["all"], F.filter(F.split(F.lower(F.array_join(F.transform(plain, lambda s: s["all"]), ",")), r"\s*,\s*"), lambda t: t.isin("noindex", "nofollow", "none")))
    content = F.when(F.size(own) > 0, text(F.element_at(own, -1))).when(F.size(near) > 0, text(F.get(near, F.lit(0)))).when(F.size(plain) > 0, joined)
    return F.when(content.isNotNull(), meta_robots(content))
