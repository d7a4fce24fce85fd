"""URL filters as a sort-merge range join with nested rules.

The key of a host is its labels in reverse, each followed by a dot: www.example.com becomes
com.example.www. and a rule for a host and all its subdomains becomes the interval of keys that
start with the rule's key. Rules are kept apart by their path; a url is looked up once for each
rule path that its own path starts with.

A sweep over the sorted interval bounds keeps a stack of the rules that are open; what is on top
after a bound holds up to the next one. Urls and bounds are then sorted together, and each url
takes the last bound before it. Bounds are copied to every task, so urls are dealt evenly and a
host with a third of all rows is no one task's load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import width

#: Action of a url that no rule fits.
DEFAULT_VERDICT = "allow"

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_and_path(url: str = "url") -> tuple:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case. Path: on to ? # or the end."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host):
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def segments(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Columns _prefix, _key, _seq, _seg: from _key on, _seg holds the innermost open rule, or null inside.

    The sweep is a fold over the sorted bounds of one rule path, whose state holds the stack."""
    frame = spark.createDataFrame(sorted(set(rules)), "action string, host string, _prefix string").dropDuplicates(["host", "_prefix"])
    key = host_key(F.col("host"))
    rule = F.struct(
        (F.length("host") + F.length("_prefix")).alias("size"), F.concat("host", "_prefix").alias("rule"), F.col("action").alias("verdict")
    )
    bounds = frame.select("_prefix", key.alias("lo"), F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/")).alias("hi"), rule.alias("r"))
    events = bounds.select(
        "_prefix",
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("key"), F.lit(1).alias("opens"), F.length("lo").alias("depth"), F.col("r")),
                F.struct(F.col("hi").alias("key"), F.lit(0).alias("opens"), (-F.length("lo")).alias("depth"), F.col("r")),
            )
        ).alias("e"),
    )
    kind = "struct<size:int,rule:string,verdict:string>"
    out_kind = f"array<struct<key:string,top:{kind}>>"
    # At one key what ends comes first, inner rules before outer ones; then what starts, outer first.
    lists = events.groupBy("_prefix").agg(F.array_sort(F.collect_list("e")).alias("es"))

    def sweep(state, e):
        stack = F.when(e["opens"] == 1, F.concat(state["stack"], F.array(e["r"]))).otherwise(
            F.slice(state["stack"], 1, F.greatest(F.size(state["stack"]) - 1, F.lit(0)))
        )
        return F.struct(
            stack.alias("stack"),
            F.concat(state["out"], F.array(F.struct(e["key"].alias("key"), F.try_element_at(stack, F.lit(-1)).alias("top")))).alias("out"),
        )

    swept = lists.select(
        "_prefix",
        F.aggregate(
            "es",
            F.struct(F.array().cast(f"array<{kind}>").alias("stack"), F.array().cast(out_kind).alias("out")),
            sweep,
            lambda s: s["out"],
        ).alias("out"),
    )
    return swept.select("_prefix", F.posexplode("out").alias("_seq", "s")).select(
        "_prefix", F.col("s.key").alias("_key"), "_seq", F.struct(F.col("s.top").alias("top")).alias("_seg")
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    The longest rule that fits wins. A null url, or one without ://, has an empty host and path
    and gets the default verdict with a null rule. Repeated rows are judged each; an empty table
    gives no rows; other columns are not read. Rules are a list with one action for each host
    and path; the driver holds them."""
    spark = pages.sparkSession
    tasks = width(spark)
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(url_col)
    urls = (
        pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_task", F.pmod(F.xxhash64("_row"), F.lit(tasks)).cast("int"))
    )
    prefixes = F.array(F.lit(""), *[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    looked = urls.withColumn("_prefix", F.explode(F.array_distinct(F.array_compact(prefixes)))).select(
        "_task", "_row", "page_id", "host", "path", "_prefix", host_key(F.col("host")).alias("_key"), F.lit(1).alias("_kind"), F.lit(0).alias("_seq")
    )
    bounds = segments(spark, rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"), "_prefix", "_key", F.lit(0).alias("_kind"), "_seq", "_seg"
    )
    last = Window.partitionBy("_task", "_prefix").orderBy("_key", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    merged = looked.unionByName(bounds, allowMissingColumns=True).repartition(tasks, "_task")
    hit = merged.withColumn("_hit", F.last("_seg", ignorenulls=True).over(last)["top"]).filter("_kind = 1")
    best = hit.groupBy("_task", "_row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("_hit").alias("_hit")
    )
    return best.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT q.page_id, q.host, q.path, r.rhost || r.rpath AS rule, r.action,
             row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
      FROM q LEFT JOIN r ON (q.host = r.rhost OR ends_with(q.host, '.' || r.rhost)) AND starts_with(q.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
