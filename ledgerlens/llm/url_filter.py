"""URL filter (operator 9): a blocked Bloom filter of the listed canonical URL
prefixes passes possible hits to an exact hash join.

A listed entry is ``host + path prefix`` (the path starts with ``/``), which
is also its canonical form: a lower-case host, no scheme, query or fragment.
An entry fits its host and all subdomains if the URL's path starts with the
entry's path. Each distinct (host, path) makes its candidate keys, one for each
host suffix and each path length that the list has; the filter drops nearly
all of them where they are made; only possible hits become rows to join.

Edge cases: a null URL, or one without ``://``, has empty host and path and
gets the default verdict. An entry that is listed with both verdicts blocks.
Of the entries that fit, the longest wins; of equally long ones that with the
longer host. Repeated rows give repeated results. An empty list gives every
URL the default verdict. Other columns of the input are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A block is one 512-bit cache line of 8 words; each key sets a bit in every word.
WORDS_PER_BLOCK = 8


def url_host(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def bloom_words(listed: DataFrame, key: str, n_blocks: int) -> np.ndarray:
    """The filter as ``n_blocks`` x 8 longs, built by one distributed
    aggregate. Its size is fixed by ``n_blocks``, whatever the list's."""
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks))
    out = np.zeros((n_blocks, WORDS_PER_BLOCK), np.int64)
    masks = [F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 7), {6 * w}) & 63 as int)))").alias(f"w{w}")
             for w in range(WORDS_PER_BLOCK)]
    for row in listed.groupBy(block.alias("b")).agg(*masks).toLocalIterator():
        out[row["b"]] = row[1:]
    return out


def bloom_test(filter_: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys may be listed. ``h1`` gives the block, ``h2`` the bits."""
    lines = filter_[np.mod(h1, len(filter_))]
    hit = np.ones(len(h1), bool)
    bits = h2.view(np.uint64)
    for w in range(WORDS_PER_BLOCK):
        hit &= (lines[:, w].view(np.uint64) >> ((bits >> np.uint64(6 * w)) & np.uint64(63))) & np.uint64(1) == 1
    return hit


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", bits_per_key: int = 16, most_filter_bytes: int = 16 << 20) -> DataFrame:
    """One row per page: id, host, path, rule (the entry that decides, or
    null) and verdict. ``listed`` has columns host, path and verdict.

    The broadcast filter takes ``bits_per_key`` bits an entry and
    ``most_filter_bytes`` at most; a fuller filter only passes more false hits
    to the join, which removes them all."""
    spark = pages.sparkSession
    listed = (listed.where("host is not null and path is not null and host <> ''")
              .select(F.concat("host", "path").alias("rule"), F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
              .select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
              .groupBy("rule", "host", "path").agg(F.max("verdict").alias("listed_verdict")))
    shape = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
                       F.collect_set(F.length("path")).alias("lengths")).first()
    n_blocks = int(max(1, min(most_filter_bytes // 64, -(-shape["n"] * bits_per_key // 512))))
    shared = spark.sparkContext.broadcast(bloom_words(listed, "rule", n_blocks))

    def possible(batches):
        for batch in batches:
            rule, h1, h2 = batch.column(2), batch.column(3), batch.column(4)
            hit = bloom_test(shared.value, h1.flatten().to_numpy(zero_copy_only=False), h2.flatten().to_numpy(zero_copy_only=False))
            at = np.flatnonzero(hit)
            row = pa.compute.list_parent_indices(rule).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), rule.flatten().take(pa.array(at))],
                                             ["host", "path", "rule"])

    page = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    lengths = F.array(*[F.lit(x) for x in sorted(shape["lengths"] or [])]).cast("array<int>")
    n_labels = int(shape["labels"] or 0)
    keys = (page.select("host", "path").distinct()
            .withColumn("parts", F.split("host", r"\."))
            .withColumn("suffixes", F.expr(f"transform(sequence(1, least(size(parts), {max(1, n_labels)})), i -> concat_ws('.', slice(parts, size(parts) - i + 1, i)))"))
            .withColumn("starts", F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
            .withColumn("keys", F.flatten(F.transform("suffixes", lambda s: F.transform("starts", lambda p: F.concat(s, p)))))
            .select("host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"),
                    F.transform("keys", lambda k: F.xxhash64(k, F.lit(7))).alias("h2")))
    hits = keys.mapInArrow(possible, "host string, path string, rule string")
    found = (hits.join(listed.select("rule", F.length("host").alias("host_length"), "listed_verdict").hint("shuffle_hash"), "rule")
             .groupBy("host", "path")
             .agg(F.max(F.struct(F.length("rule").alias("length"), "host_length", "rule", "listed_verdict")).alias("best")))
    return (page.join(found, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.listed_verdict"), F.lit(default)).alias("verdict")))


#: The rules of the registered query: host, path prefix, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark, sf_dir) -> DataFrame:
    """Every page's host, path, rule and verdict under ``RULES``; a page that
    no rule fits is not listed and so allowed."""
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"), listed)


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
d AS (SELECT DISTINCT host, path FROM hp),
b AS (
  SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, hp.host, hp.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM hp LEFT JOIN b ON hp.host = b.host AND hp.path = b.path
"""
