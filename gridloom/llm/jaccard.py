"""Links between texts of a given Jaccard similarity of word shingles, by prefix filtering; it completes SimHash.

Under any fixed order of shingles, two sets of similarity t or more share one of the first ``n - ceil(t * n) + 1`` of each.
So sets meet under their first shingles only, and no pair is missed; and if they first meet late in either, the rest can't
hold enough for t.  The order is that of the hashes, but shingles
that several sets have come last: which these are is estimated from a part of the texts, and as any order is right, that
changes how many sets meet, but no result.  Where many sets still meet, they are near copies for the most part: each is held
against one of the others first, and then only those that are not in one component yet are held against each other.

Pairs that meet are held against each other by their parities first: for each of 1024 places whether an odd number of a
set's shingles fall on it.  Two sets differ in at least as many shingles as places, so this leaves out no similar pair,
and where few differ it is nearly as sharp as the texts themselves.  What is left is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import joinable, settled, slices, stored
from gridloom.llm.components import components
from gridloom.llm.shingles import lower_words, majority, shingle_hashes

#: Shingles that OFTEN or more of the sets of one text in SAMPLE have come last in the order; they are marked in a bitmap of
#: 2 ** MARKS bits by their hash, whatever their number.
OFTEN, SAMPLE, MARKS = 2, 8, 24
#: In buckets up to this size all pairs are held against each other at once.
SMALL = 64
#: A task holds no more than about so many sets of a bucket at a time; larger ones are cut.
BLOCK = 20_000
BROADCAST_ROWS = 200_000
#: 64-bit words of the parities that pairs are held against each other by.
WIDE = 16

SIGNS = "doc_id long, th long, fp long, sh long, size int, prefix array<long>, " + ", ".join(f"w{i} long" for i in range(WIDE))


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _least(n, percent: int):
    """The smallest whole number that is percent / 100 of n."""
    return -(-n * percent // 100)


def _shared(sizes, percent: int):
    """How many shingles sets of so many together have to share."""
    return -(-sizes * percent // (100 + percent))


def parities(own: np.ndarray) -> np.ndarray:
    """WIDE words of the parity of how many shingles fall on each place."""
    places = (own ^ (own >> np.uint64(32))) & np.uint64(64 * WIDE - 1)
    odd = np.bincount(places.astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _prefix(own: np.ndarray, percent: int, late: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set; those marked as late come last."""
    if len(late):
        place = own >> np.uint64(64 - MARKS)
        last = (late[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        own = np.r_[own[~last], own[last]]
    return own[: len(own) - _least(len(own), percent) + 1]


def _late(docs: DataFrame, shingle: int, seed: int, percent: int) -> np.ndarray:
    """Bitmap of the shingles that several sets have, as 64-bit words.  It has one size, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in slices(batches):
            parts = [none]
            for text in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(lower_words(text), shingle, seed))
                parts.append(own[: 3 * len(_prefix(own, percent, none)) // 2])  # what may come to be first when others are last
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["key"])

    part = docs.select("text", text_hash().alias("th")).filter(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]).select("text")
    often = part.mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= OFTEN)
    place = F.shiftrightunsigned("key", 64 - MARKS)
    words = often.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("bit"))
    out = np.zeros(1 << MARKS - 6, np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"] % (1 << 64)
    return out


def signs(docs: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame:
    """SIGNS of every row: hash of the text, SimHash fingerprint, hash of the set of its shingles, the set's size, first
    shingles (null where the task has given those of the same set before) and parities."""
    late = docs.sparkSession.sparkContext.broadcast(_late(docs, shingle, seed, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        given: set[int] = set()
        for batch in slices(batches):
            fps, sets, sizes, prefixes, wide = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                every = shingle_hashes(lower_words(text), shingle, seed)
                own = np.unique(every)
                fps.append(majority(every))
                sets.append(xxhash.xxh64_intdigest(own.tobytes(), 1))
                sizes.append(len(own))
                wide.append(parities(own))
                if sets[-1] in given:
                    prefixes.append(None)
                    continue
                if len(given) > 100_000:
                    given.clear()
                given.add(sets[-1])
                prefixes.append(_prefix(own, percent, late.value).view(np.int64))
            signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            ends = np.cumsum([0, *(0 if p is None else len(p) for p in prefixes)], dtype=np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *(p for p in prefixes if p is not None)])
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([p is None for p in prefixes], pa.bool_()))
            parts = np.concatenate([np.zeros(0, np.uint64), *wide]).reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("th"), signed(fps), signed(sets), pa.array(sizes, pa.int32()), prefix, *(signed(parts[:, i]) for i in range(WIDE))],
                ["doc_id", "th", "fp", "sh", "size", "prefix", *(f"w{i}" for i in range(WIDE))],
            )

    return docs.select("doc_id", "text", text_hash().alias("th")).mapInArrow(run, SIGNS)


def _meet(percent: int):
    """Arrow function over entries (key, size, sh, at) sorted by these: pairs (u, v) that may be similar by ``_fit``.

    All pairs of small buckets; of the others, by parts of BLOCK sets, each set v with the middle one u, with the key as ``open``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, sh, place in _buckets(batches, ["key", "size", "sh", "at"], BLOCK):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            short = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            k, n, s, p = key[short], size[short], sh[short], place[short]
            for d in range(1, SMALL):
                same = k[d:] == k[:-d]
                if not same.any():
                    break
                fit = same & _fit(n[:-d], p[:-d], n[d:], p[d:], percent)
                if fit.any():
                    yield _pairs(s[:-d][fit], s[d:][fit], None)
            for a, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                h = a + m // 2
                fit = _fit(size[a : a + m], place[a : a + m], size[h], place[h], percent)
                yield _pairs(np.full(int(fit.sum()), sh[h]), sh[a : a + m][fit], key[a])
                yield _pairs(sh[h : h + 1], sh[h : h + 1], key[a])

    return run


def _fit(n, i, m, j, percent: int):
    """Whether sets of n and m shingles that meet under the i-th of one and the j-th of the other, and under none before, may be
    similar: the rest must hold what they have to share.  If they meet before, they are found there."""
    return (np.minimum(n - i, m - j) >= _shared(n + m, percent)) & (np.minimum(n, m) >= _least(np.maximum(n, m), percent))


def _cross(percent: int):
    """Arrow function over entries (key, size, sh, at, root, far, home, w0 ...) of parts of the larger buckets: the pairs
    (u, v) of different components that may be similar by ``_fit`` and by their parities.

    far: the set is outside its bucket's largest component.  One of a pair is, so only those sets look for others; they come
    to every part of the bucket, the others only to one, their home.
    """
    names = ["key", "size", "sh", "at", "root", "far", "home", *(f"w{i}" for i in range(WIDE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, sh, place, root, far, home, *wide in _buckets(batches, names, None):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for a, m in zip(starts.tolist(), np.diff(np.r_[starts, len(key)]).tolist(), strict=True):
                n, s, p, r, w = size[a : a + m], sh[a : a + m], place[a : a + m], root[a : a + m], [x[a : a + m] for x in wide]
                out, here = far[a : a + m] == 1, home[a : a + m] == 1
                for i in np.flatnonzero(out).tolist():
                    near = np.flatnonzero((r != r[i]) & here & (~out | (s > s[i])) & _fit(n, p, n[i], p[i], percent))
                    apart = sum(np.bitwise_count((x[near] ^ x[i]).view(np.uint64)).astype(np.int64) for x in w)  # of signed numbers it counts otherwise
                    near = near[apart <= n[near] + n[i] - 2 * _shared(n[near] + n[i], percent)]
                    if len(near):
                        yield _pairs(np.full(len(near), s[i]), s[near], None)

    return run


def _pairs(u, v, key) -> pa.RecordBatch:
    opened = pa.nulls(len(u), pa.int64()) if key is None else pa.array([int(key)] * len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), opened], ["u", "v", "open"])


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str], most: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of the columns (key, size, sh and others) of rows sorted by these, each set once under a key.

    They are cut between keys, and where a key has more than ``most`` rows, also there.
    """
    held: list[list[np.ndarray]] = []

    def whole() -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(p) for p in zip(*held, strict=True)]
        key, sh = columns[0], columns[2]
        once = np.r_[True, (key[1:] != key[:-1]) | (sh[1:] != sh[:-1])]
        return tuple(c[once] for c in columns)

    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        if not len(part[0]):
            continue
        last = int(np.searchsorted(part[0], part[0][-1]))  # this bucket may go on
        if last or (held and held[-1][0][-1] != part[0][0]):
            held.append([p[:last] for p in part])
            yield whole()
            held = []
        held.append([p[last:] for p in part])
        if most is not None and sum(len(p[0]) for p in held) > most:
            yield whole()
            held = []
    if held:
        yield whole()


def _verified(pairs: DataFrame, sets: DataFrame, known: DataFrame, docs: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) of sets that aren't in one component of ``known`` and whose similarity is percent / 100 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: dict[str | None, np.ndarray] = {}

            def of(text: str | None) -> np.ndarray:
                if text not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[text] = np.unique(shingle_hashes(lower_words(text), shingle, seed))
                return seen[text]

            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = of(a), of(b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def found() -> DataFrame:
        own = sets.join(known, sets.sh == known.node, "left").select("sh", "size", "th", F.coalesce("root", "sh").alias("root"), *[f"w{i}" for i in range(WIDE)])
        left, right = (own.select(*[F.col(c).alias(f"{side}_{c}") for c in own.columns]) for side in "uv")
        ordered = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        met = ordered.join(left, F.col("u") == F.col("u_sh")).join(right, F.col("v") == F.col("v_sh"))
        apart = sum((F.bit_count(F.col(f"u_w{i}").bitwiseXOR(F.col(f"v_w{i}"))) for i in range(WIDE)), F.lit(0))
        both = F.col("u_size") + F.col("v_size")
        near = met.filter((F.col("u_root") != F.col("v_root")) & (apart <= both - 2 * F.ceil(both * percent / (100 + percent) - 1e-9)))
        close = stored(near.select("u", "v", F.col("u_th").alias("ut"), F.col("v_th").alias("vt")), "pairs")
        wanted = stored(close.select(F.explode(F.array("ut", "vt")).alias("th")).distinct(), "pair-texts")
        texts = docs.select("text", text_hash().alias("th")).join(joinable(wanted, BROADCAST_ROWS), "th").groupBy("th").agg(F.first("text").alias("text"))
        texts = stored(texts, "pair-docs")
        whole = close.join(texts.select(F.col("th").alias("ut"), F.col("text").alias("a")), "ut").join(texts.select(F.col("th").alias("vt"), F.col("text").alias("b")), "vt")
        return whole.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")

    return settled("similar", found)


def links(docs: DataFrame, signs: DataFrame, sets: DataFrame, known: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame:
    """(u, v): links between sets of a Jaccard similarity of percent / 100 or more that, with those that made ``known``, leave
    the same components as all links.

    signs: of the rows of docs, stored.  sets: (sh, size, th, w0, ...), one row a set, stored.  known: (node, root), the
    components that are known already: their members aren't held against each other.
    """
    order = ["key", "size", "sh"]
    flat = signs.select(F.posexplode("prefix").alias("at", "key"), "size", "sh", *[f"w{i}" for i in range(WIDE)])
    met = flat.select(*order, "at").repartition("key").sortWithinPartitions(*order).mapInArrow(_meet(percent), "u long, v long, open long")
    met = stored(met, "met")
    one = met.filter("open is not null").groupBy("v").agg(F.min("u").alias("u")).select("u", "v")  # of large buckets, one for each
    found = _verified(met.filter("open is null").select("u", "v").union(one), sets, known, docs, shingle, seed, percent)
    opened = met.filter("open is not null").select(F.col("open").alias("key")).distinct()
    if opened.isEmpty():
        return found
    tree = known.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = stored(components(tree.union(found)), "jaccard-roots")
    rest = flat.join(joinable(opened, BROADCAST_ROWS), "key").join(roots, flat.sh == roots.node, "left").withColumn("root", F.coalesce("root", "sh")).drop("node")
    by_root = rest.groupBy("key", "root").agg(F.count("*").alias("sets"))
    tops = by_root.groupBy("key").agg(F.max_by("root", "sets").alias("top"), F.ceil(F.sum("sets") / BLOCK).alias("parts"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    far, own = F.col("root") != F.col("top"), F.pmod(F.xxhash64("sh"), F.col("parts"))
    parts = F.when(far, F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = rest.join(joinable(stored(tops, "tops"), BROADCAST_ROWS), "key").withColumns({"far": far.cast("int"), "own": own}).withColumn("part", F.explode(parts))
    dealt = dealt.withColumns({"key": F.xxhash64("key", "part"), "home": (F.col("part") == F.col("own")).cast("int")}).drop("top", "parts", "part", "own")
    more = dealt.repartition("key").sortWithinPartitions(*order).mapInArrow(_cross(percent), "u long, v long, open long").select("u", "v")
    return found.union(_verified(more, sets, roots, docs, shingle, seed, percent))
