"""URL rules by hashed host-suffix and path-prefix expressions (operator 6), in DataFrame functions only.

A rule is a host and a path prefix; it fits the host and its subdomains where the path starts with the
rule's. Each URL becomes one expression for every shape (labels of the host, characters of the path) that
the rules use; expressions and rules meet by the first bytes of their SHA-256, and full digests confirm.
The longest fitting rule decides, then the one with the longer host, then block before allow.

Rules beyond what a broadcast may hold are joined by the same keys with a shuffle, as Spark decides by size.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; a URL that
no rule fits gets the default verdict and a null rule; URLs of any length are judged whole; repeated rows each get
their row; repeated rules count once; of rules that tie, block wins; an empty rule list leaves all to the default, an
empty table gives an empty result; extra columns may be carried through by name (``keep``), but ones with the names of
the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_host string, rule_path string, verdict string"
HASH_PREFIX = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """keep..., host, path, rule, verdict, n_matches for every row of ``pages``. rules: RULE_SCHEMA."""
    keep = tuple(c for c in keep if c.lower() not in ("host", "path", "rule", "verdict", "n_matches"))
    rules = rules.where("rule_host is not null and rule_path is not null").distinct()
    shapes = [(r.n, r.k) for r in rules.select(_labels(F.col("rule_host")).alias("n"), F.length("rule_path").alias("k")).distinct().orderBy("n", "k").collect()]
    base = pages.select(F.monotonically_increasing_id().alias("_row"), *keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    expressions = F.array(*[
        F.when((_labels(F.col("host")) >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k)))
        for n, k in shapes
    ]) if shapes else F.array(F.lit(None).cast("string"))
    found = F.filter(expressions, lambda e: e.isNotNull())
    spread = base.select("*", F.explode_outer(found).alias("_expr"))
    spread = spread.withColumn("_full", F.sha2("_expr", 256)).withColumn("_key", F.substring("_full", 1, HASH_PREFIX)).drop("_expr")
    rule = F.concat("rule_host", "rule_path")
    table = rules.select(F.substring(F.sha2(rule, 256), 1, HASH_PREFIX).alias("_key"), F.sha2(rule, 256).alias("_rule_full"), rule.alias("_rule"), F.length(rule).alias("_size"), F.length("rule_host").alias("_host_size"), F.col("verdict").alias("_verdict"))
    hit = spread.join(table, "_key", "left")
    ranked = F.when(F.col("_full") == F.col("_rule_full"), F.struct("_size", "_host_size", F.when(F.col("_verdict") == "block", 1).otherwise(0).alias("_strict"), F.col("_rule"), F.col("_verdict")))
    best = hit.groupBy("_row", *keep, "host", "path").agg(F.max(ranked).alias("_best"), F.count(ranked).alias("n_matches"))
    return best.select(*keep, "host", "path", F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"), "n_matches")
