"""URL verdicts: a blocked Bloom filter of listed keys, then an exact hash join that removes its false positives.

Everything is DataFrame functions. A listed key is `host + path`; a URL is tried under every suffix of its host and
under the prefixes of its path that have the length of some listed path. The Bloom filter has blocks of four 64-bit
words; a key sets one bit in each word of one block.

Nulls and oddities: a null URL, or one without `://`, has an empty host and path and gets the default verdict, as does
every URL that no listed key fits; a repeated URL is judged once and each of its rows is returned; a key listed twice
keeps its smallest verdict ('allow' before 'block'). An empty list lets every URL pass to the default. Extra columns
are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Bits a key gets in the filter, and the largest filter that is broadcast: 4 words of 8 bytes for each block.
BITS_PER_KEY = 16
MOST_BLOCKS = 1 << 20

#: (host, path, verdict) of the registered query; fixed values.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return shared.lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    h = F.xxhash64(key, F.lit(word))
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a column `key`: at most `blocks` rows, whatever the number of keys."""
    return (
        keys.select(_block(F.col("key"), blocks).alias("block"), *(_bit(F.col("key"), i).alias(f"b{i}") for i in range(4)))
        .groupBy("block")
        .agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(4)))
    )


def passes(rows: DataFrame, keys: DataFrame, n_keys: int, column: str) -> DataFrame:
    """The rows whose column is among keys (key), and a few more: what a filter of bounded size lets pass."""
    blocks = blocks_for(n_keys)
    own = rows.columns
    tried = rows.withColumn("_block", _block(F.col(column), blocks)).join(F.broadcast(bloom(keys, blocks)), F.col("_block") == F.col("block"))
    for i in range(4):
        tried = tried.where(F.col(f"w{i}").bitwiseAND(_bit(F.col(column), i)) != 0)
    return tried.select(*own)


def blocks_for(n_keys: int) -> int:
    """Blocks of 256 bits for so many keys; capped, so that the filter keeps its size bound and only gets less selective."""
    return max(1, min(MOST_BLOCKS, -(-n_keys * BITS_PER_KEY // 256)))


def judge(urls: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) of each distinct url.

    urls: a column url. listed: host, path, verdict. The longest listed key that fits wins.
    """
    keys = listed.select(F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), "verdict")
    facts = keys.agg(F.count("*").alias("keys"), F.array_sort(F.collect_set("n")).alias("lengths")).first()
    exact = keys.groupBy("key").agg(F.min("verdict").alias("verdict"))

    seen = urls.select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*(F.lit(n) for n in facts["lengths"])).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    tried = (
        seen.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("url", F.explode("prefixes").alias("prefix"), "suffix")
        .select("url", F.concat("suffix", "prefix").alias("key"))
    )
    found = (
        passes(tried, keys, facts["keys"], "key")
        .join(exact, "key")
        .groupBy("url")
        .agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
        .select(F.col("url").alias("hit_url"), "best")
    )
    return seen.join(found, seen["url"] == found["hit_url"], "left").select(
        "url", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page's URL under RULES; a URL that no rule fits isn't listed and is allowed."""
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.range(1).select(
        F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES)))
    )
    verdicts = judge(pages, listed).withColumnRenamed("url", "judged")
    return pages.join(verdicts, pages["url"].eqNullSafe(verdicts["judged"]), "left").select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT page_id, max_by({'rule': rhost || rpath, 'verdict': verdict}, length(rhost || rpath)) AS best
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN hits USING (page_id)
"""
