"""Near-duplicate records: b-bit MinHash signatures, banded candidates, exact check."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.sources.tables import durable

BITS, SLOTS = 2, 512  # low bits kept of each of so many minima: 16 longs a signature


def words(text: Column) -> Column:
    """Distinct words of a text: unbroken runs of letters or digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def word_classes(df: DataFrame, item: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(members: item, class_id; classes: class_id, hashes): rows with one and the same set of words form a class, named by its least item.

    Rows whose set is null or empty belong to no class; repeated rows count once; an item that comes
    with several sets keeps the one of the least digest. Sets are cut into words once and written; digests
    alone are grouped, with map-side combine, so a text copied any number of times is one short row a task.
    """
    hashes = F.array_sort(F.transform(tokens, lambda w: F.xxhash64(w)))
    rows = df.select(F.col(f"`{item}`").alias("item"), hashes.alias("hashes")).where("item is not null and size(hashes) > 0")
    sets = durable(rows.select("item", F.struct(F.xxhash64("hashes").alias("d1"), F.xxhash64(F.lit(5), F.reverse("hashes")).alias("d2")).alias("d"), "hashes"), "sets")
    own = sets.groupBy("item").agg(F.min("d").alias("d"))
    members = durable(own.join(own.groupBy("d").agg(F.min("item").alias("class_id")), "d").select("item", "class_id", "d"), "members")
    first = members.where("item = class_id").select(F.col("item").alias("class_id"), F.col("d").alias("_d"))
    classes = sets.join(first, (F.col("item") == F.col("class_id")) & (F.col("d") == F.col("_d"))).groupBy("class_id").agg(F.first("hashes").alias("hashes"))
    classes._durable_path = sets._durable_path  # the sets are not needed once the classes are signed
    return members.select("item", "class_id"), classes


def _minima(hashes: pd.Series, count: int, seed: int) -> np.ndarray:
    """Minima of so many hash functions a * x + b modulo 2**32 over each set: one row a function, one column a set."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = draw.integers(0, 2**32, count, dtype=np.uint32)
    n = hashes.map(len).to_numpy()
    wide = np.concatenate(hashes.to_numpy()).astype(np.int64).view(np.uint64)
    flat = (wide >> np.uint64(32)).astype(np.uint32) ^ wide.astype(np.uint32)
    start = n.cumsum() - n
    low, x = np.empty((count, len(hashes)), np.uint32), np.empty_like(flat)
    for k in range(count):
        np.multiply(flat, a[k], out=x)
        np.add(x, b[k], out=x)
        np.minimum.reduceat(x, start, out=low[k])
    return low


def signatures(classes: DataFrame, bands: int, rows: int, seed: int = 11) -> DataFrame:
    """class_id, hashes, sig: packed bits of the first SLOTS minima.

    The two bits that are kept of each minimum are mixed from its lower half, where words that
    differ at all agree by chance only.
    """
    slots = min(SLOTS, bands * rows // 32 * 32)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                low = _minima(pdf["hashes"], bands * rows, seed)[:slots]
                two = (low * np.uint32(0x9E3779B1)) >> np.uint32(14) & np.uint32(3)
                packed = np.bitwise_or.reduce(two.astype(np.uint64).reshape(slots // 32, 32, -1) << (np.uint64(2) * np.arange(32, dtype=np.uint64))[None, :, None], axis=1)
                yield pd.DataFrame({"class_id": pdf["class_id"], "hashes": pdf["hashes"], "sig": list(np.ascontiguousarray(packed.T).view(np.int64))})

    return classes.mapInPandas(run, "class_id bigint, hashes array<bigint>, sig array<bigint>")


def signed_classes(classes: DataFrame, bands: int, rows: int, seed: int = 11) -> DataFrame:
    """Signatures of all classes, written once; the table of word sets that `classes` reads is removed then.

    The band keys, more than half of a class's bytes, are not kept: `band_keys` works them out again.
    """
    signed = durable(signatures(classes, bands, rows, seed), "signatures", classes)
    signed._bands = (bands, rows, seed)
    return signed


def estimated(a: Column, b: Column, longs: Column) -> Column:
    """Similarity from two packed signatures of so many longs, corrected for chance matches of the low bits."""
    miss = F.zip_with(a, b, lambda p, q: F.bit_count((x := p.bitwiseXOR(q)).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    agree = 1 - F.aggregate(miss, F.lit(0), lambda p, q: p + q) / (longs * 32.0)
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def band_keys(signed: DataFrame) -> DataFrame:
    """(key, class_id): one row for each band of each class; a key is the band and 32 bits of its minima."""
    bands, rows, seed = signed._bands

    def run(batches):
        for pdf in batches:
            if len(pdf):
                low = _minima(pdf["hashes"], bands * rows, seed)
                key = np.zeros((bands, len(pdf)), np.uint64)
                for r in range(rows):
                    key = (key ^ low[r::rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                whole = (np.arange(bands, dtype=np.int64) << 32)[:, None] + (key >> np.uint64(32)).astype(np.int64)
                yield pd.DataFrame({"key": whole.ravel(), "class_id": np.tile(pdf["class_id"].to_numpy(), bands)})

    return signed.select("class_id", "hashes").mapInPandas(run, "key bigint, class_id bigint")


def verified(pairs: DataFrame, signed: DataFrame, threshold: float, margin: float = 0.12) -> DataFrame:
    """Pairs (a, b, similarity) with Jaccard similarity >= threshold: by the estimate from a quarter of the signature, then from all of it, then exactly.

    The estimates may fall short of the threshold by 2 * margin and by margin, over four of
    their standard errors. Chance candidates, nearly all, thus move with a quarter of a signature only.
    """

    def both(p: DataFrame, values: DataFrame) -> DataFrame:
        return p.join(values.select(F.col("class_id").alias("a"), F.col("x").alias("xa")), "a").join(values.select(F.col("class_id").alias("b"), F.col("x").alias("xb")), "b")

    head = signed.select("class_id", F.slice("sig", 1, SLOTS // 128).alias("x"))
    close = both(pairs, head).where(estimated(F.col("xa"), F.col("xb"), F.size("xa")) >= threshold - 2 * margin).select("a", "b")
    close = both(close, signed.select("class_id", F.col("sig").alias("x"))).where(estimated(F.col("xa"), F.col("xb"), F.size("xa")) >= threshold - margin).select("a", "b")
    common = F.size(F.array_intersect("xa", "xb"))
    exact = both(close, signed.select("class_id", F.col("hashes").alias("x")))
    return exact.select("a", "b", (common / (F.size("xa") + F.size("xb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def similar_classes(signed: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, similarity) of classes, a < b, with Jaccard similarity >= threshold.

    Candidates share a band key. Keys that occur once, nearly all, are dropped after the one exchange
    of all keys (a count over rows of two numbers, which spills and holds no group in memory);
    the rest is joined with itself on the key, and AQE splits hot keys there. With bands of r
    minima a pair of similarity s is missed with a chance of (1 - s**r)**bands. The number of
    rows is that of the pairs there are; `linking_pairs` serves where only groups are wanted.
    """
    keyed = band_keys(signed).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").drop("n")
    keyed = durable(keyed, "buckets")
    left, right = keyed.select("key", F.col("class_id").alias("a")), keyed.select("key", F.col("class_id").alias("b"))
    # spread by a, as the first join needs it, so that the distinct pairs are not moved twice
    return verified(left.join(right, "key").where("a < b").select("a", "b").repartition("a").distinct(), signed, threshold)


def linking_pairs(signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that link the same groups as `similar_classes`, without all pairs of a tight group.

    First every class is compared with the least class of each of its keys; the links found
    make components. Two classes of one component need no further comparison, so of
    each key that holds several components only the classes outside its first component meet
    the other classes of the key. A key whose classes are all alike thus costs one
    comparison a class, and no link between two components is passed over.
    """
    keyed = durable(band_keys(signed), "keys")
    least = keyed.groupBy("key").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a < z").select("key", "a")
    stars = keyed.join(least, "key").where("class_id <> a").select("a", F.col("class_id").alias("b")).distinct()
    found = durable(verified(stars, signed, threshold).select("a", "b"), "links")
    roots = components(found)
    held = keyed.join(least, "key").select("key", "class_id").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("key", "class_id", F.coalesce("root", "class_id").alias("root"))
    held = durable(held, "held", keyed)
    mixed = held.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("other")).where("main < other").select("key", "main")
    held = held.join(mixed, "key")
    outside = held.where("root <> main").select("key", F.col("class_id").alias("x"), F.col("root").alias("rx"))
    rest = outside.join(held.select("key", F.col("class_id").alias("y"), F.col("root").alias("ry")), "key").where("rx <> ry")
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return found.unionByName(durable(verified(rest, signed, threshold).select("a", "b"), "links"))


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) from links (a, b); only nodes with a link appear.

    Large-star and small-star steps until nothing changes; each round is written to the
    shared folder and the one before is removed. Neighbours are never gathered: a step is a minimum per node and a join.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = durable(small.where("u != v").distinct(), "edges", edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_pairs(members: DataFrame, close: DataFrame) -> DataFrame:
    """Pairs (a, b) of different items, a < b: all of one class, and all across two similar classes."""
    links = close.select("a", "b").unionByName(members.groupBy("class_id").count().where("count > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    m = members.select("class_id", "item")
    wide = links.join(m.select(F.col("class_id").alias("a"), F.col("item").alias("x")), "a").join(m.select(F.col("class_id").alias("b"), F.col("item").alias("y")), "b")
    return wide.where("(a = b and x < y) or (a < b and x != y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per item: item, class_id, group_id (least class of its component)."""
    roots = components(links.select("a", "b"))
    return members.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("item", "class_id", F.coalesce("root", "class_id").alias("group_id"))


def link_counts(members: DataFrame, close: DataFrame) -> DataFrame:
    """One row per item: item, class_id, n_links (different texts that it is similar to)."""
    close = durable(close.select("a", "b"), "close")
    ends = close.select(F.col("a").alias("class_id")).unionByName(close.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return members.join(ends, "class_id", "left").select("item", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))
