"""SimHash near-duplicates with multi-index hashing.

Fingerprints are cut into segments.  Two that differ in at most ``distance`` bits differ in at most
``distance // segments`` bits of one segment, so each fingerprint is filed under its segments and looked up under all
values of the small Hamming ball round each; what meets in a bucket is verified over all 64 bits.  Of two values one
is smaller, so only the ball's members that are not larger than the own value are looked up.

A few bits of 64 are less than what near copies of a given Jaccard similarity may differ in, and balls of that radius are too
large to enumerate.  Where such a similarity is asked for, the links between fingerprints are completed by ``jaccard``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import jaccard
from gridloom.llm.common import settled, slices, stored
from gridloom.llm.components import components
from gridloom.llm.shingles import lower_words, majority, shingle_hashes

BITS = 64
#: Buckets above this many entries are linked through shared midpoints instead of comparing their members.
HEAVY = 50_000
#: From this many distinct fingerprints on, two segments make fewer candidates than three.
TWO_SEGMENTS = 1 << 26

def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed long.  A null text has no words: fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [majority(shingle_hashes(lower_words(t), shingle, seed)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------------------------------------------- links
def _segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment, low bits first."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ball(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _entries(distance: int, segments: int):
    """Arrow function from fp to (key, filed, fp): filed rows stand under their own value, the others look up."""
    parts = [(k, low, np.uint64((1 << width) - 1), _ball(width, distance // segments)) for k, (low, width) in enumerate(_segments(segments))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, 400_000 // max(len(b) for *_, b in parts))
            for lo in range(0, len(every), step):
                fp = every[lo : lo + step]
                for k, low, mask, ball in parts:
                    value = (fp >> np.uint64(low)) & mask
                    other = value[:, None] ^ ball[None, :]
                    i, j = np.nonzero(other <= value[:, None])
                    key = (other[i, j] | np.uint64(k << 56)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(j == 0), pa.array(fp[i].view(np.int64))], ["key", "filed", "fp"])

    return run


def _forest(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints that lie within ``distance``: linear in number."""
    rest = np.unique(fp)
    queue: list[np.uint64] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        near = np.bitwise_count(rest ^ at) <= distance
        if near.any():
            for x in rest[near]:
                yield at, x
            queue.extend(rest[near])
            rest = rest[~near]


def _meet(distance: int, heavy: int):
    """Arrow function over entries sorted by key: (u, v) links, and (u, null) for the members of heavy buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, filed, fp = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)
        over = None  # the key of a heavy bucket that is being passed through

        def out(u, v, plain=True) -> pa.RecordBatch:
            u, v = np.asarray(u, np.uint64).view(np.int64), np.asarray(v, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v) if plain else pa.nulls(len(u), pa.int64())], ["u", "v"])

        def buckets(key: np.ndarray, filed: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            use = (sizes > 1) & np.logical_or.reduceat(filed, starts)
            short = np.repeat(use & (sizes <= 32), sizes)
            k, f = key[short], fp[short]
            for d in range(1, 32):
                same = k[d:] == k[:-d]
                if not same.any():
                    break
                a, b = f[:-d][same], f[d:][same]
                near = (a != b) & (np.bitwise_count(a ^ b) <= distance)
                if near.any():
                    yield out(a[near], b[near])
            for s, n in zip(starts[use & (sizes > 32)].tolist(), sizes[use & (sizes > 32)].tolist(), strict=True):
                if links := list(_forest(fp[s : s + n], distance)):
                    yield out([a for a, _ in links], [b for _, b in links])

        for batch in batches:
            k, d, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "filed", "fp"))
            f = f.view(np.uint64)
            if over is not None:
                n = int(np.searchsorted(k, over, "right"))
                yield out(f[:n], f[:n], False)
                k, d, f = k[n:], d[n:], f[n:]
                over = over if not len(k) else None
            key, filed, fp = np.r_[key, k], np.r_[filed, d], np.r_[fp, f]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # this bucket may go on
            yield from buckets(key[:last], filed[:last], fp[:last])
            key, filed, fp = key[last:], filed[last:], fp[last:]
            if len(key) > heavy:
                yield out(fp, fp, False)
                over = int(key[-1])
                key, filed, fp = key[:0], filed[:0], fp[:0]
        yield from buckets(key, filed, fp)

    return run


def _midpoints(heavy: DataFrame, distance: int) -> DataFrame:
    """Links between all fingerprints within ``distance`` up to connection, at a fixed cost for each.

    Two lie that close just if some value is within half the distance of either; each is linked to the
    smallest fingerprint that shares a value with it.
    """
    near = _ball(BITS, distance // 2).view(np.int64).tolist()
    far = near if distance % 2 == 0 else _ball(BITS, distance - distance // 2).view(np.int64).tolist()

    def around(masks: list[int]) -> DataFrame:
        table = heavy.sparkSession.createDataFrame([(masks,)], "masks array<long>")
        return heavy.join(F.broadcast(table)).select("fp", F.explode("masks").alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))

    least = around(near).groupBy("mid").agg(F.min("fp").alias("v"))
    return around(far).join(least, "mid").select(F.col("fp").alias("u"), "v").filter("u <> v").distinct()


def links(distinct: DataFrame, distance: int = 4, segments: int | None = None, heavy: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that leave the same components as all links."""
    heavy = HEAVY if heavy is None else heavy
    if segments is None:
        segments = 3 if distinct.count() < TWO_SEGMENTS else 2
    entries = distinct.select("fp").mapInArrow(_entries(distance, segments), "key long, filed boolean, fp long")
    met = stored(entries.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(distance, heavy), "u long, v long"), "met")
    found = met.filter("v is not null")
    members = met.filter("v is null").select(F.col("u").alias("fp")).distinct()
    if members.isEmpty():
        return found
    return found.union(_midpoints(stored(members, "heavy"), distance))


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links reach, itself included.  Exact copies meet in one fingerprint, so
    only distinct fingerprints are compared.  Texts without words (null, empty) have fingerprint 0 and are linked
    like any other; a bit that just half of the shingles have is 0; very long texts are counted whole.  Rows that repeat a
    doc_id keep their own fingerprints, and a null doc_id is never the smallest
    unless a component has no other.  Other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle, seed), "fingerprints")

    def rooted() -> DataFrame:
        firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
        roots = components(links(firsts, distance))
        return firsts.join(roots, firsts.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")

    of = settled("roots", rooted)
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, shingle: int = 5, distance: int = 4, percent: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp, component_id, first) for every row of ``docs``: near-duplicates by fingerprints and by similarity.

    Texts are linked if their fingerprints differ in at most ``distance`` bits or the sets of their shingles have a Jaccard
    similarity of percent / 100 or more.  component_id is the smallest doc_id that links reach, itself included; first is
    true for the rows with that id and, of several texts with that id in the component, the one of the smallest hash.
    th is the XXH64 of the text (null: empty), so that (doc_id, th) tells texts apart that share an id.  Texts
    without words have one empty set and are copies of each other.  A null doc_id is never the smallest unless a
    component has no other.  Very long texts are compared whole.  Other columns are ignored; an empty table gives no rows.
    """
    signs = stored(jaccard.signs(docs, shingle, seed, percent), "signs")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    others = ["size", *[f"w{i}" for i in range(jaccard.WIDE)]]

    def trees() -> DataFrame:
        prints = stored(signs.groupBy("fp", "sh").agg(F.lit(1).alias("one")).select("fp", "sh"), "fingerprints")
        roots = components(links(prints.select("fp").distinct(), distance))
        of = stored(prints.join(roots, prints.fp == roots.node, "left").select("sh", F.coalesce("root", "fp").alias("root")), "roots")
        least = of.groupBy("root").agg(F.min("sh").alias("v"))
        return of.join(least, "root").select(F.col("sh").alias("u"), "v").filter("u <> v").distinct()

    def rooted() -> DataFrame:
        sets = stored(signs.groupBy("sh").agg(F.min(row).alias("row"), F.min("th").alias("th"), *[F.first(c).alias(c) for c in others]), "sets")
        tree = settled("tree", trees)
        known = settled("known", lambda: components(tree))
        roots = components(tree.union(jaccard.links(docs, signs, sets, known, shingle, seed, percent)))
        return sets.join(roots, sets.sh == roots.node, "left").select("sh", F.coalesce("root", "sh").alias("root"), "row")

    of = settled("roots", rooted)
    firsts = of.groupBy("root").agg(F.min("row").alias("least"))
    met = signs.select("doc_id", "th", "fp", "sh").join(of.join(firsts, "root").select("sh", "least"), "sh")
    first = F.col("doc_id").eqNullSafe(F.col("least")["doc_id"]) & (F.col("th") == F.col("least")["th"])
    return met.select("doc_id", "th", "fp", F.col("least")["doc_id"].alias("component_id"), first.alias("first"))
