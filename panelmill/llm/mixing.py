"""Mixing sources to target token shares by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators.ranks import cumulate
from panelmill.sources.tables import durable

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(text: Column, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> Column:
    """Number of tokens of the whole text; 0 for null. The vocabulary file goes from the driver to the executors."""
    SparkSession.active().sparkContext.addFile(os.path.join(folder, vocabulary))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(SparkFiles.get(vocabulary)).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def source_name(c: Column) -> Column:
    """Name of a source without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def apportion(shares: dict[str, float], caps: dict[str, int], seats: int) -> dict[str, int]:
    """Seats by the highest quotients share / (2 * seats + 1), no more than the cap of each.

    Equals handing out seat after seat (ties: greater share, then name); found by
    bisection on the divisor, so the number of seats does not matter. If the caps leave
    fewer seats than asked for, all of them are filled.
    """
    names = [s for s in shares if shares[s] > 0 and caps.get(s, 0) > 0]
    if seats >= sum(caps[s] for s in names):
        return {s: caps[s] if s in names else 0 for s in shares}
    give = lambda d: {s: min(caps[s], int(shares[s] / d + 0.5)) for s in names}
    low, high = min(shares[s] / (2 * caps[s] + 2) for s in names), 2 * max(shares[s] for s in names) + 1
    for _ in range(2000):
        mid = (low * high) ** 0.5
        if sum(give(mid).values()) > seats:
            low = mid
        else:
            high = mid
        if high / low - 1 < 1e-15:
            break
    out = give(high)
    while (left := seats - sum(out.values())) > 0:
        best = sorted((s for s in names if out[s] < caps[s]), key=lambda s: (-shares[s] / (2 * out[s] + 1), -shares[s], s))
        for s in best[:1]:
            out[s] += 1
        if left <= 0 or not best:
            break
    return {s: out.get(s, 0) for s in shares}


def shard_seats(shards: DataFrame, reach: int = 2) -> DataFrame:
    """Adds due: the seats of a source (column seats) among its shards (source, shard, own) by the highest quotients own / (2 * seats + 1); ties by shard.

    A shard's seats lie near its proportional part; the quotients of `reach` seats to either side of
    it compete, ranked by running counts over ranges, so no task holds a source. If one of
    them turns out too narrow anywhere, it is widened and the ranking is done again.
    """
    shards = durable(shards, "shards")
    while True:
        sums = shards.groupBy("source").agg(F.sum("own").alias("_all"))
        x = shards.join(sums, "source").withColumn("_base", F.floor(F.col("seats") * F.col("own") / F.col("_all"))).withColumn("_sure", F.greatest(F.col("_base") - reach, F.lit(0)))
        given = x.groupBy("source").agg((F.first("seats") - F.sum("_sure")).alias("_open"))
        cells = x.select("source", "shard", F.explode(F.sequence(F.col("_sure"), F.col("_base") + reach)).alias("_k"), "own")
        cells = cells.select("source", "shard", (-F.col("own") / (2 * F.col("_k") + 1)).alias("_q"), F.lit(1).alias("_one"))
        won = cumulate(cells, "source", ["_q", "shard"], "_one", 4096).join(given, "source").where(F.col("upto") <= F.col("_open")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("_won"))
        out = durable(x.join(won, ["source", "shard"], "left").withColumn("_won", F.coalesce("_won", F.lit(0))), "seats")
        narrow = (F.col("_won") > F.col("_base") + reach - F.col("_sure")) | ((F.col("_won") == 0) & (F.col("_sure") > 0))
        if not out.where(narrow).limit(1).count():
            return out.withColumn("due", F.col("_sure") + F.col("_won")).drop("_all", "_base", "_sure", "_won")
        reach = 4 * reach + 1


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 4096, shard_tokens: int = 2_000_000, seed: int = 7) -> DataFrame:
    """Documents of the mix: doc_id, source, n_tokens, repeats (1..max_repeats).

    docs has doc_id, source and n_tokens; targets has source (unique), target_share and
    max_repeats. The mix holds total_tokens (default: the tokens of all listed sources), as
    far as the repeat limits allow: a source that is too small for its share is taken
    max_repeats times, and its missing tokens go to the others by the same rule. Sources
    that are not in targets, with null names, and documents without tokens are left out. An
    empty corpus gives an empty mix.

    Every source is cut into shards of about shard_tokens by a hash of doc_id, a shard into
    blocks of about block_tokens in hash order (a document is never cut; a longer one is a
    block of its own size). Blocks go to sources and then to their shards by highest
    quotients; a shard takes whole passes over its blocks and, for the rest, blocks in
    the order of a seeded hash. A hot source has as many tasks as shards.
    """
    names = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.col("max_repeats").alias("most"))
    listed = durable(docs.select("doc_id", source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint")).where("n_tokens > 0").join(names, "source").select("doc_id", "source", "n_tokens", "most"), "listed")
    have = {r["source"]: r["n"] for r in listed.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    want = {r["source"]: r for r in names.collect()}
    limit = {s: have[s] * want[s]["most"] for s in want if have.get(s)}
    whole: set[str] = set()  # sources that cannot fill their seats
    while True:
        left = {s: n for s, n in limit.items() if s not in whole}
        seats = max(0, round(((total_tokens or sum(have.values())) - sum(limit[s] for s in whole)) / block_tokens))
        quota = apportion({s: want[s]["target_share"] for s in left}, {s: -(-n // block_tokens) for s, n in left.items()}, seats)
        short = {s for s in left if quota[s] * block_tokens > left[s]}
        if not short:
            break
        whole |= short
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, quota.get(s, 0), max(1, -(-have[s] // shard_tokens)), have[s], s in whole) for s in limit if s in whole or quota[s]], "source string, seats bigint, shards bigint, tokens bigint, whole boolean")
    rows = listed.join(plan, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = durable(rows.withColumn("block", F.floor((F.sum("n_tokens").over(line) - F.col("n_tokens")) / block_tokens)), "blocks")
    blocks = rows.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("size"), F.first("seats").alias("seats"), F.first("most").alias("most"), F.first("whole").alias("whole"))
    shards = blocks.groupBy("source", "shard").agg(F.sum("size").alias("own"), F.first("seats").alias("seats"), F.first("most").alias("most"), F.first("whole").alias("whole"))
    shards = shard_seats(shards).withColumn("tokens_due", F.col("due") * block_tokens)
    shards = shards.select("source", "shard", F.when(F.col("whole"), F.col("most")).otherwise(F.least(F.floor(F.col("tokens_due") / F.col("own")), F.col("most"))).alias("passes"), "own", "tokens_due")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    picked = blocks.select("source", "shard", "block", "size", "most", F.sum("size").over(order).alias("upto")).join(shards, ["source", "shard"])
    extra = (F.col("passes") < F.col("most")) & (F.col("upto") - F.col("size") / 2 <= F.col("tokens_due") - F.col("passes") * F.col("own"))
    picked = picked.select("source", "shard", "block", (F.col("passes") + F.when(extra, 1).otherwise(0)).cast("int").alias("repeats")).where("repeats > 0")
    return rows.select("doc_id", "source", "n_tokens", "shard", "block").join(picked, ["source", "shard", "block"]).select("doc_id", "source", "n_tokens", "repeats")


def reached(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: shares asked for and reached, tokens there and taken, documents, most repeats, and whether the repeat limit was met."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    there = docs.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("tokens_there"))
    base = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = base.join(got, "source", "left").join(there, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.sum(zero("tokens")).over(Window.partitionBy(F.lit(1)))
    share = F.when(total > 0, zero("tokens") / total).otherwise(0.0)
    return rows.select("source", "target_share", share.alias("reached_share"), zero("tokens").alias("tokens"), zero("tokens_there").alias("tokens_there"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"), "max_repeats", ((zero("tokens") > 0) & (zero("tokens") >= zero("tokens_there") * F.col("max_repeats"))).alias("at_limit"))
