"""URL filter: a sort-merge range join of urls with host/path rules.

The host is written with its labels reversed, each followed by a dot
(``www.example.net`` -> ``net.example.www.``).  In that order a host and
all its subdomains are one interval, and intervals of rules are nested or
disjoint.  Urls are range-partitioned and sorted by this key (then path),
so a host with a third of all rows is spread over many tasks; each task
sweeps its sorted rows along the sorted rules and keeps the rules whose
interval holds the current key on a stack.  Of the stacked rules whose
path starts the url's path the longest (host + path) wins; between equal
lengths ``block`` wins.

Rules are sent to the tasks in blocks of at most ``BROADCAST_BYTES``; each
further block is one more sweep over the same sorted partitions, without
another shuffle, and keeps the longest fit so far.

Defined results: a null url or one without ``://`` has empty host and
path, fits no rule and gets the default verdict; repeated rows are judged
alike and all returned; an empty rule table gives every url the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import BROADCAST_BYTES, ascii_lower, table, with_python_columns

#: Fixed by the task: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def url_host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(rules: list[tuple[str, str, str, str]]):
    """Maker of a function of sorted rows; ``rules`` are (key, path, rule, verdict) sorted by key."""

    def make():
        stack: list[tuple[str, list]] = []  # (key of the rule's host, its rules)
        nxt = 0

        def sweep(keys, paths, old_rules, verdicts, lengths):
            nonlocal nxt
            out = []
            for key, path, rule, verdict, length in zip(keys, paths, old_rules, verdicts, lengths, strict=True):
                while nxt < len(rules) and rules[nxt][0] <= key:
                    top = rules[nxt][0]
                    while stack and not top.startswith(stack[-1][0]):
                        stack.pop()
                    if stack and stack[-1][0] == top:
                        stack[-1][1].append(rules[nxt])
                    else:
                        stack.append((top, [rules[nxt]]))
                    nxt += 1
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                for _, own in stack:
                    for _, rpath, text, rverdict in own:
                        if path.startswith(rpath) and (
                            len(text) > length or len(text) == length and rverdict == "block" != verdict
                        ):
                            rule, verdict, length = text, rverdict, len(text)
                out.append((rule, verdict, length))
            return [[x[k] for x in out] for k in range(3)]

        return sweep

    return make


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``pages``.

    ``rules`` has columns verdict, host and path.
    """
    url = F.col(url_col)
    keyed = (
        pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"))
        .withColumn("_key", host_key(F.col("host")))
        .withColumns({
            "rule": F.lit(None).cast("string"), "verdict": F.lit(default), "_len": F.lit(-1),
        })
        .repartitionByRange("_key", "path", id_col)
        .sortWithinPartitions("_key", "path")
    )
    ruled = rules.select(
        host_key(ascii_lower(F.col("host"))).alias("key"), "path",
        F.concat(ascii_lower(F.col("host")), F.col("path")).alias("rule"), "verdict",
    )
    size = ruled.agg(F.sum(F.length("key") + F.length("rule") + F.length("path") + 64).alias("b")).first()["b"] or 0
    n_blocks = max(1, -(-int(size) // BROADCAST_BYTES))
    for k in range(n_blocks):
        own = ruled.where(F.pmod(F.xxhash64("rule", "verdict"), F.lit(n_blocks)) == k) if n_blocks > 1 else ruled
        block = sorted(tuple(r) for r in own.distinct().collect())
        keyed = with_python_columns(
            keyed, ["_key", "path", "rule", "verdict", "_len"], {"rule": "string", "verdict": "string", "_len": "int"}, _sweep(block)
        )
    return keyed.select(id_col, "host", "path", "rule", "verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH r(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after
  FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(after, '') AS after FROM u)
)
SELECT page_id, host, path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM r
        WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM r
        WHERE (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)), 'allow') AS verdict
FROM h
"""
