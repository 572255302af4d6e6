"""URL filters by rules on host suffixes and path prefixes.

Each distinct (host, path) is expanded into its host suffixes joined with those path prefixes whose
length some rule has; the expressions meet the rules in an equi-join on the first bytes of their
digests, full digests confirm, and the longest rule wins (then the longer host, then block).

Defined results: a null URL, or one without ``://``, has empty host and path; no rule then fits and the
verdict is the default. Repeated pages keep their rows. An empty table, or no rules, is no special case.
Columns of ``pages`` other than the named outputs pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``."""
    parts = F.split(host, r"\.", -1)
    return F.transform(
        F.transform(F.array(parts), lambda p: F.transform(p, lambda _, i: F.concat_ws(".", F.slice(p, i + 1, F.size(p)))))[0],
        lambda suffix: suffix,
    )


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` to the pages.

    Rules are joined as any table: Spark broadcasts them where their size is known to be small, and
    shuffles both sides by the digest prefix otherwise.
    """
    spark = pages.sparkSession
    outputs = ["host", "path", "rule", "verdict"]
    parsed = pages.drop(*outputs).withColumns({"host": F.coalesce(host_of(F.col(url_col)), F.lit("")), "path": F.coalesce(path_of(F.col(url_col)), F.lit(""))})

    named = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
    lengths = sorted(r[0] for r in named.select(F.length("rule_path")).distinct().collect())
    named = named.withColumn("rule_digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
    named = named.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))

    keys = parsed.select("host", "path").where(F.col("host") != "").distinct()
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = (
        keys.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("length", F.explode(cut))
        .select("host", "path", F.sha2(F.concat("suffix", F.substr("path", F.lit(1), F.col("length"))), 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("of_host"), "rule_verdict", F.concat("rule_host", "rule_path").alias("rule")
    )
    best = (
        expressions.join(named, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(order).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    )
    if not lengths:
        best = spark.createDataFrame([], "host string, path string, rule string, verdict string")
    judged = parsed.join(best, ["host", "path"], "left")
    return judged.select(*[c for c in pages.columns if c not in outputs], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
"""
