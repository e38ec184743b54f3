"""Near-duplicate components by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Bucketed, Scratch, small
from ._shingles import mix, shingle_set

#: Permutations; each gives a minimum and a maximum, so a signature has twice as many values.
PERMUTATIONS = 64
#: 25 bands of 5 values: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^25 = 5e-5.
BANDS, ROWS = 25, 5
#: Members of a bucket that are compared with one another in one task.
BLOCK = 512
#: Texts that a worker holds at a time.
TEXTS = 500

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 1 << 62, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64)
_BAND = _RNG.integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum and the maximum of the shingles under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 1024):
        x = shingles[None, i : i + 1024] * _A
        x += _B
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band of signature values; keys of different bands differ."""
    bands = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    return mix((bands * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(width: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                counts, digests, bands = [], [], []
                for text in some.column(2).cast(pa.binary()).to_pylist():
                    found = shingle_set(text or b"", width)
                    counts.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    bands.append(band_keys(signature(found)) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, schema.field(4).type)],
                    schema=schema,
                )

    return work


def _confirm(width: int, percent: int):
    """Keep the pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
            a, b, ta, tb = (c.cast(pa.binary()).to_pylist() if i > 1 else c.to_pylist() for i, c in enumerate(batch.columns))
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, of_last = a[i], shingle_set(ta[i] or b"", width)
                other = shingle_set(tb[i] or b"", width)
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(of_last) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return work


def _explode(width: int):
    """Each text's shingle set as an array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                sets = [shingle_set(x or b"", width).view(np.int64) for x in some.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return work


def _short_sign(width: int):
    """The last byte of each signature value that bands use, and the band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
            values = [signature(shingle_set(x or b"", width)) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            signs = [(v[: BANDS * ROWS] & np.uint64(255)).astype(np.uint8).tobytes() for v in values]
            bands = [band_keys(v).tobytes() for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.binary()), pa.array(bands, pa.binary())], names=["node", "sign", "bands"])

    return work


def least_agreement(percent: int) -> float:
    """The share of equal signature values that a link falls short of with a probability of 3e-5 at most (4 standard deviations)."""
    p = percent / 100
    return p - 4 * math.sqrt(p * (1 - p) / (BANDS * ROWS))


def _matrix(column: pd.Series, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def _sizes_fit(n: int, others: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, others) >= percent * np.maximum(n, others)


def _pair_frame(a: list, b: list) -> pd.DataFrame:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _nearest(percent: int, partners: int = 3):
    """Of each member outside its bucket's largest component: the most alike members of other components in its block."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        signs, node, n, c = _matrix(group["sign"], np.uint8), *(group[x].to_numpy() for x in ("node", "n", "c"))
        a, b = [], []
        for i in np.flatnonzero(group["outside"].to_numpy()):
            alike = np.where((c != c[i]) & _sizes_fit(n[i], n, percent), (signs == signs[i]).mean(axis=1), 0)
            best = np.argsort(-alike, kind="stable")[:partners]
            best = best[alike[best] >= least_agreement(percent)]
            a.append(np.full(len(best), node[i]))
            b.append(node[best])
        return _pair_frame(a, b)

    return work


def _plausible(percent: int):
    """The pairs of a block of members and some outside ones that may be links: other component, sizes and signatures that fit.

    A pair stands in the first bucket that it shares, so that it comes up once.
    """

    def work(key: tuple, group: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(group) and len(probes):
            signs, bands = _matrix(group["sign"], np.uint8), _matrix(group["bands"], np.int64)
            node, n, c, outside = (group[x].to_numpy() for x in ("node", "n", "c", "outside"))
            for i, ni, ci, sign, band in zip(probes["node"], probes["n"], probes["c"], _matrix(probes["sign"], np.uint8), _matrix(probes["bands"], np.int64)):
                fits = (c != ci) & _sizes_fit(ni, n, percent) & (~outside | (node > i))
                at = np.flatnonzero(fits & ((signs == sign).mean(axis=1) >= least_agreement(percent)))
                at = at[band[(bands[at] == band).argmax(axis=1)] == key[0]]
                a.append(np.full(len(at), i))
                b.append(node[at])
        return _pair_frame(a, b)

    return work


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for all nodes of ``edges`` (``a``, ``b``).

    Alternating large and small stars (Kiveris et al., 2014). Neighbours' minima are aggregated before they are shuffled and joined back, so
    no node's neighbours are gathered. Rounds grow as the logarithm of the number of nodes; each is a written table.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.where(F.col("a") != F.col("b"))
    seen = None
    while True:
        last = edges if seen is not None else None
        edges = scratch.save(star(scratch.save(star(edges, True), "large"), False), "small")
        if last is not None:
            scratch.forget(last)
        now = state(edges)
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``text_key`` (the text's xxhash64) per row of ``docs``.

    A document's set is its distinct ``width``-word shingles (words between ASCII white space, A-Z lower-cased); documents
    whose sets have 100 * intersection >= ``percent`` * union are linked, and ``component_id`` is the smallest id reachable.

    1. Documents with equal sets are one node (its id the smallest). 2. Nodes with a band key in common share a bucket.
    3. Every member of a bucket is compared with the bucket's pivot (its smallest node) on the full sets: first only with the
    smallest pivot it has, then, where that left them in different components, with the others. 4. Where the other members still lie in
    different components, those go that provably link with no other one (too many of their shingles stand in no other member).
    5. Members outside their bucket's largest component are compared with the three most alike ones of a block of it, on the full sets,
    and then with every member of another component whose size and signature may be a link's. So every pair that shares a
    bucket is compared, or ruled out by counts or by a signature four standard deviations off, or lies in one component.
    Signatures are compared in blocks within tasks; only pairs that pass are rows.

    Texts of nodes that share a bucket are dealt once to a table bucketed by node; both sides of every comparison read it where it lies.

    Texts without words (or null) have no shingles, are linked with nothing, and stay. Rows that repeat an id
    are one document; should their texts differ, the set with the smallest digest is compared for all. A null id is linked only with
    equal sets. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))
    signed = source.select("doc_id", "text_key", "text").mapInArrow(
        _sign(width), "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"
    )
    signed = scratch.save(signed, "signed")
    differ = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("other"))
    differ = scratch.save(differ.where(F.col("d") != F.col("other")).select(F.col("doc_id").alias("d_id"), "d"), "differ")
    rows = signed.where(F.col("digest").isNotNull())
    n_differ = differ.count()
    if n_differ:
        chosen = small(differ, n_differ)
        rows = rows.join(chosen, F.col("doc_id") == F.col("d_id"), "left").where(F.col("d").isNull() | (F.col("d") == F.col("digest"))).drop("d_id", "d")
    nodes = scratch.save(
        rows.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.min_by("text_key", "doc_id").alias("text_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ),
        "nodes",
    )
    members = nodes.where(F.col("node").isNotNull()).select("node", "n", "text_key", F.explode("bands").alias("key"))
    pivots = scratch.save(
        members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where(F.col("size") > 1).drop("size"),
        "pivots",
    )
    members = scratch.save(members.join(small(pivots, pivots.count()), "key"), "members")
    wanted = scratch.save(members.select(F.col("node").alias("w_id"), F.col("text_key").alias("w_key")).distinct(), "wanted")
    n_wanted = wanted.count()
    of_node = (F.col("doc_id") == F.col("w_id")) & F.col("text_key").eqNullSafe(F.col("w_key"))
    texts = source.join(small(wanted, n_wanted), of_node, "left_semi").select(F.col("doc_id").alias("node"), "text")
    table = Bucketed(texts, "node", scratch, distinct=True)
    texts = table.rows
    links = scratch.save(spark.createDataFrame([], "a long, b long"), "links")
    sizes = nodes.select("node", "n")
    comps = spark.createDataFrame([], "node long, component long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        full = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
        return full.mapInArrow(_confirm(width, percent), "a long, b long")

    def merge(pairs: DataFrame) -> None:
        nonlocal links, comps
        new = scratch.save(confirmed(pairs), "links")
        if new.isEmpty():
            return
        links = links.unionByName(new)
        comps = scratch.save(connected_components(links, scratch), "components")
        links = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))

    def component(of: str, name: str, rows: DataFrame) -> DataFrame:
        named = comps.select(F.col("node").alias(of), F.col("component").alias(name))
        return rows.join(named, of, "left").withColumn(name, F.coalesce(name, of))

    def plausible(pairs: DataFrame) -> DataFrame:
        """Without the pairs whose sizes alone rule a link out."""
        return pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")

    stars = members.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb"))
    stars = stars.distinct().join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
    stars = scratch.save(plausible(stars), "stars")
    merge(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    rest = component("b", "cb", component("a", "ca", stars)).where(F.col("ca") != F.col("cb"))
    merge(scratch.save(rest.select("a", "b").exceptAll(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "rest"))

    def divided(rows: DataFrame) -> DataFrame:
        """The members of buckets that hold two components."""
        labelled = component("node", "c", rows.select("key", "node", "n"))
        split = labelled.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where(F.col("c1") != F.col("c2"))
        return scratch.save(labelled.join(split.select("key"), "key"), "divided")

    def hopeful(rows: DataFrame) -> DataFrame:
        """Without the members that provably link with no other one of their bucket.

        A shingle that no other member has lies in no intersection. With c shingles left of n, a link with a set of m
        needs c >= percent * (n + m) / (100 + percent), and m is at least the bucket's smallest set and percent of n.
        """
        sets = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_explode(width), "node long, shingles array<long>")
        single = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("node"))
        own = single.where(F.col("k") == 1).groupBy("node").agg(F.count("*").alias("own"))
        least = rows.groupBy("key").agg(F.min("n").alias("m"))
        other = F.greatest(F.col("m"), F.ceil(F.col("n") * percent / 100))
        enough = (100 + percent) * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * (F.col("n") + other)
        return rows.join(own, "node", "left").join(least, "key").where(enough).select("key", "node", "n")

    def shrunk(rows: DataFrame) -> DataFrame:
        left = rows.count()
        while left:
            rows = divided(hopeful(rows))
            before, left = left, rows.count()
            if left > 0.9 * before:
                break
        return rows

    def signed_members(rows: DataFrame) -> DataFrame:
        """``rows`` with signatures, ``block`` (about ``BLOCK`` random members of a bucket) and ``outside`` (not of its largest component)."""
        signs = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_short_sign(width), "node long, sign binary, bands binary")
        counts = rows.groupBy("key", "c").agg(F.count("*").alias("k"))
        main = counts.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.ceil(F.sum("k") / BLOCK).alias("blocks"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
        outside = (F.col("c") != F.col("main")).alias("outside")
        return scratch.save(rows.join(main, "key").join(signs, "node").select("key", "blocks", block, outside, "node", "n", "c", "sign", "bands"), "signs")

    open_ = shrunk(divided(members.where(F.col("node") != F.col("pivot"))))
    if not open_.isEmpty():
        near = signed_members(open_).groupBy("key", "block").applyInPandas(_nearest(percent), "a long, b long")
        merge(scratch.save(near.distinct(), "nearest"))
        open_ = shrunk(divided(open_.select("key", "node", "n")))
    if not open_.isEmpty():
        rows = signed_members(open_)
        probes = rows.where("outside")
        rounds = probes.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("rounds"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        asked = probes.join(rounds, "key").withColumn("round", F.pmod(F.xxhash64("node", F.lit(1)), "rounds"))
        asked = asked.select("key", "round", "node", "n", "c", "sign", "bands", every("blocks").alias("block"))
        asked = asked.toDF(*asked.columns)  # columns of its own: the cogroup's sides come from one table
        held = rows.join(rounds, "key").select("key", "block", "outside", "node", "n", "c", "sign", "bands", every("rounds").alias("round"))
        by = ("key", "block", "round")
        found = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(_plausible(percent), "a long, b long")
        merge(scratch.save(found, "plausible"))

    owners = scratch.save(component("node", "component_id", nodes.select("digest", "node")).select("digest", "component_id"), "owners")
    table.delete()
    own = signed.select("doc_id", "n_shingles", "digest", "text_key")
    if n_differ:
        own = own.join(small(differ, n_differ), F.col("doc_id") == F.col("d_id"), "left").withColumn("digest", F.coalesce("d", "digest")).drop("d_id", "d")
    found = F.coalesce("component_id", "doc_id")
    return own.join(owners, "digest", "left").select(
        "doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"), "text_key"
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4).drop("text_key")
