"""URL filters: a blocked Bloom filter in front of an exact hash join.

A rule is a host and the beginning of a path, listed as `host/path`. It fits an
url if the url's host is the rule's or a subdomain of it, and the url's path
begins with the rule's. Of the rules that fit, the longest (host and path) wins;
of equally long ones that with the longer host, and of equal rules `block`.

Each distinct (host, path) of the urls is looked up under all its host endings
and all path lengths that rules have. The keys first meet a blocked Bloom filter
of the rules: 512-bit blocks, one bit in each of a block's eight words, so that
a key reads one block. Keys that pass are possible hits and go to an exact join
with the rules, which removes the false ones. The filter has at most MAX_BLOCKS
blocks (about 8 MB), whatever the length of the list, and so may be broadcast;
a longer list only lets more false hits through to the join.

Defined cases: a null url, or one without `://`, has an empty host and path and
fits no rule; without a rule the verdict is `allow`; repeated urls get the same
verdict; an empty list allows everything; other columns of the urls are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import changed_ascii_case, let
from ..plans.scratch import stored
from .common import others, packed, quoted, table

#: The filter's largest size in blocks of 512 bits.
MAX_BLOCKS = 1 << 17
#: Bits of filter for each rule, as far as MAX_BLOCKS goes.
BITS_PER_RULE = 32
#: Distinct path lengths that rules may have (a length is a key for each url).
MAX_PATH_LENGTHS = 4_096
#: The rules of the query, as (rule, action).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return changed_ascii_case(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, rule, action) of listed rules (rule, action), one row for each host and path."""
    cut = rules.where("rule is not null").select(changed_ascii_case(F.substring_index("rule", "/", 1)).alias("rule_host"), F.expr("if(instr(rule, '/') > 0, substring(rule, instr(rule, '/')), '')").alias("rule_path"), "action")
    return cut.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action")).select("rule_host", "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "action")


def _place(host: Column, path: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bit in each of the block's eight words."""
    bits = F.xxhash64(path, F.lit(17), host)
    return F.pmod(F.xxhash64(host, F.lit(3), path), F.lit(blocks)), [F.shiftright(bits, 6 * w).bitwiseAND(F.lit(63)).cast("int") for w in range(8)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the blocks of the filter that have bits."""
    block, places = _place(F.col("rule_host"), F.col("rule_path"), blocks)
    rows = rules.select(block.alias("block"), *[_bit(p).alias(f"w{w}") for w, p in enumerate(places)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(8)])


def possible_hits(keys: DataFrame, rules: DataFrame, blocks: int) -> DataFrame:
    """The keys (rule_host, rule_path, ...) that the filter lets through."""
    block, places = _place(F.col("rule_host"), F.col("rule_path"), blocks)
    met = keys.withColumn("block", block).join(F.broadcast(bloom(rules, blocks)), "block")
    passed = F.lit(True)
    for w, p in enumerate(places):
        passed &= F.col(f"w{w}").bitwiseAND(_bit(p)) != 0
    return met.where(passed).drop("block", *[f"w{w}" for w in range(8)])


def _keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, path, rule_host, rule_path): every ending of the host with every path length."""
    ends = let(F.split("host", r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    each = urls.where("host != ''").select("host", "path", F.explode(ends).alias("rule_host"))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    return each.select("*", F.explode(fits).alias("n")).select("host", "path", "rule_host", F.expr("substring(path, 1, n)").alias("rule_path"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of the distinct (host, path) that a rule fits."""
    rules = stored(canonical(rules), "rules")
    n_rules = rules.count()
    lengths = [r.n for r in rules.select(F.char_length("rule_path").alias("n")).distinct().limit(MAX_PATH_LENGTHS + 1).collect()]
    if len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"rules have more than {MAX_PATH_LENGTHS} different path lengths")
    blocks = min(MAX_BLOCKS, max(1, n_rules * BITS_PER_RULE // 512 + 1))
    distinct = urls.select("host", "path").distinct()
    if not lengths:
        return distinct.limit(0).select("host", "path", F.lit("").alias("rule"), F.lit("").alias("action"))
    hits = possible_hits(_keys(distinct, lengths), rules, blocks).join(rules, ["rule_host", "rule_path"])
    best = F.max_by(F.struct("rule", "action"), F.struct(F.char_length("rule"), F.char_length("rule_host")))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with __host, __path, __rule and __verdict of their urls; columns of these names, in any case, make way."""
    own = F.col(f"row.{quoted(url)}")
    placed = packed(pages).select("row", host_of(own).alias("host"), path_of(own).alias("path"))
    joined = placed.join(matched(placed.select("host", "path"), rules), ["host", "path"], "left")
    made = {"__host": F.col("host"), "__path": F.col("path"), "__rule": F.col("rule"), "__verdict": F.coalesce("action", F.lit("allow"))}
    return joined.select(*others(pages.columns, *made), *[c.alias(n) for n, c in made.items()])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(list(RULES), "rule string, action string")
    found = judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM (SELECT DISTINCT host, path FROM cut) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT page_id, cut.host, cut.path, fits.rule, coalesce(fits.action, 'allow') AS verdict
FROM cut LEFT JOIN fits ON cut.host = fits.host AND cut.path = fits.path
"""
