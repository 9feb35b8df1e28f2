"""Robots policy: rules of the matching groups, longest prefix wins, ties allow, no rule allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.urls import LOWER, UPPER, origin_of, path_of

AGENT = "tarn-bot/0.1"
_TRIM = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def parse_robots(bodies: DataFrame, agent: str = AGENT, origin: str = "origin", body: str = "body") -> DataFrame:
    """origin, rule_no (from 1, in file order), allow, path of the rules that bind `agent`.

    A group is governed by the user-agent line before it; the rules of all matching groups count.
    Comments go, keys are case-insensitive, empty values are no rules. A null body has no rules.
    The window is over one origin's file.
    """
    own = agent.translate(str.maketrans(UPPER, LOWER))
    raw = bodies.select(F.col(origin).alias("origin"), F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line"))
    line = _trim(F.regexp_extract("line", r"^([^#]*)", 1))
    rows = raw.withColumn("line", line).where("line <> ''")
    key = _trim(F.translate(F.regexp_extract("line", r"^([^:]*)", 1), UPPER, LOWER))
    value = F.when(F.col("line").contains(":"), _trim(F.regexp_extract("line", r"^[^:]*:([\s\S]*)$", 1))).otherwise(F.col("line"))
    keyed = rows.select("origin", "line_no", key.alias("key"), value.alias("value"))
    name = F.translate(F.when(F.col("key") == "user-agent", F.col("value")), UPPER, LOWER)
    matches = F.when(F.col("key") == "user-agent", (name == "*") | F.lit(own).contains(name) | name.contains(F.lit(own)))
    w = Window.partitionBy("origin").orderBy("line_no")
    bound = keyed.withColumn("binds", F.last(matches, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rules = bound.where(F.coalesce("binds", F.lit(False)) & F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.select("origin", F.row_number().over(w).alias("rule_no"), (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with origin, path and allowed.

    Rules are one array per origin (a file's worth), so an origin with very many urls costs no more
    rows, and the verdict is an expression over the array.
    """
    listed = rules.groupBy("origin").agg(F.collect_list(F.struct(F.octet_length("path").alias("n"), "allow", "path")).alias("_rules"))
    rows = urls.withColumn("origin", origin_of(url)).withColumn("path", path_of(url)).join(listed, "origin", "left")
    fitting = F.filter(F.coalesce("_rules", F.array().cast("array<struct<n:int,allow:boolean,path:string>>")), lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    return rows.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_rules")


def origins_to_load(urls: DataFrame, loaded: DataFrame | None = None, url: str = "url") -> DataFrame:
    """origin, robots_url of the origins whose file isn't loaded yet; each once."""
    origins = urls.select(origin_of(url).alias("origin")).where("origin <> ''").distinct()
    if loaded is not None:
        origins = origins.join(loaded.select("origin"), "origin", "left_anti")
    return origins.withColumn("robots_url", F.concat("origin", F.lit("/robots.txt")))


def cache_stats(rules: DataFrame, origins: DataFrame) -> DataFrame:
    """One row: n_origins, n_with_rules."""
    with_rules = rules.select("origin").distinct().withColumn("has", F.lit(1))
    return origins.select("origin").distinct().join(with_rules, "origin", "left").agg(F.count("*").alias("n_origins"), F.count("has").alias("n_with_rules"))
