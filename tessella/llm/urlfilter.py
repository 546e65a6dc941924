"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

The filter is a table of blocks of 512 bits (eight longs). A URL's hash names
one block, and six bits in it; a probe therefore reads one row. The table is
joined by block number, so it may be of any size; Spark broadcasts it where
its files are small. URLs whose six bits are set go on to an exact hash join
with the listed canonical URLs, which removes false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import written
from tessella.sources.tables import table

BLOCK_BITS, WORDS, PROBES = 512, 8, 6
BITS_PER_URL = 12

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The query's list is made of the pages of hosts that have one of these names as a whole label. Fixed values.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0), *_LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a last slash, and the sorted query without tracking parameters.

    Scheme and fragment go. Null where the URL has no ``://``.
    """
    query = F.regexp_extract(_after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|gclid|fbclid)(=|$)"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit(""))
    short = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(short, F.regexp_replace(path(url), r"/+$", ""), tail))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    fits = lambda h, p: ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return reduce(lambda done, r: done.when(fits(r[0], r[1]), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))), longest, F).otherwise(F.lit(None)) if longest else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(url: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(url), blocks)


def _bits(url: Column) -> list[Column]:
    """Per word of a block, the bits that the URL sets in it."""
    drawn = F.xxhash64(url, F.lit(1))
    at = [F.shiftrightunsigned(drawn, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]
    words = []
    for w in range(WORDS):
        set_ = [F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), a.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("bigint")) for a in at]
        words.append(reduce(Column.bitwiseOR, set_))
    return words


def bloom(listed: DataFrame, bits: int = BITS_PER_URL) -> DataFrame:
    """Blocks of the filter over ``listed.url_key``: block, blocks, w0 .. w7."""
    n = listed.count()
    blocks = max(1, -(-n * bits // BLOCK_BITS))
    url = F.col("url_key")
    rows = listed.select(_block(url, F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(url))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).withColumn("blocks", F.lit(blocks))


def listed_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Distinct canonical URLs of a list, as url_key."""
    return urls.select(canonical(F.col(column)).alias("url_key")).where("url_key IS NOT NULL").distinct()


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, column: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, possible and listed.

    ``listed`` has url_key, canonical URLs. Without a rule, a page is blocked
    where its canonical URL is listed. A null URL, or one without ``://``, has
    empty host and path and is allowed. Columns of these names are replaced,
    and those that begin with an underscore may be. Repeated rows stay; nothing is listed
    by an empty list.
    """
    keys = written(listed.select("url_key").where("url_key IS NOT NULL").distinct(), "listed")
    filter_ = written(bloom(keys), "bloom")
    blocks = max(1, -(-keys.count() * BITS_PER_URL // BLOCK_BITS))
    url = F.col(f"`{column}`")
    # Rows without a key meet no block; they are dealt over negative numbers, as they may be many.
    parts = [F.col(f"`{c}`") for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    nowhere = -1 - F.pmod(F.xxhash64(*parts), F.lit(1 << 20))
    out = pages.withColumn("_key", canonical(url)).withColumn("_block", F.when(F.col("_key").isNotNull(), _block(F.col("_key"), F.lit(blocks))).otherwise(nowhere))
    for i, b in enumerate(_bits(F.col("_key"))):
        out = out.withColumn(f"_b{i}", b)
    of = filter_.select(F.col("block").alias("_of_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
    probed = out.join(of, F.col("_block") == F.col("_of_block"), "left")
    hit = reduce(Column.__and__, [F.col(f"_w{i}").bitwiseAND(F.col(f"_b{i}")) == F.col(f"_b{i}") for i in range(WORDS)])
    probed = probed.withColumn("possible", F.coalesce(hit & F.col("_key").isNotNull(), F.lit(False)))
    probed = probed.drop("_block", "_of_block", *[f"_{k}{i}" for k in "bw" for i in range(WORDS)])
    # Only possible hits meet the list.
    maybe = probed.where("possible").join(keys.select(F.col("url_key").alias("_listed")), F.col("_key") == F.col("_listed"), "left")
    sure = probed.where("NOT possible").withColumn("_listed", F.lit(None).cast("string"))
    exact = maybe.unionByName(sure).withColumn("listed", F.col("_listed").isNotNull()).drop("_key", "_listed")
    found = exact.withColumn("host", host(url)).withColumn("path", path(url)).withColumn("_rule", rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.coalesce(F.col("_rule.verdict"), method)).drop("_rule")


def sites(url: Column, names: tuple[str, ...] = LISTED_SITES) -> Column:
    """Whether one of the names is a whole label of the URL's host."""
    return F.concat(F.lit("."), host(url), F.lit(".")).rlike(r"\.(" + "|".join(names) + r")\.")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = listed_urls(pages.where(sites(F.col("url"))))
    return judged(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
  list_filter(string_split(coalesce(regexp_extract(rest, '(?s)^[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)')) AS kept, rest FROM cut),
keyed AS (SELECT page_id, host, path, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END AS key FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches('.' || host || '.', '\.(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
ruled AS (SELECT page_id, host, path, key, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM keyed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN key IN (SELECT key FROM listed WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
