"""Benchmark decontamination with a distributed positional inverted index.

Every run of ``n`` words of a benchmark item is a phrase.  Words are counted over the corpus.  Of each phrase the two rarest
terms are its anchors, and further ones where the places at which those would meet by chance cost more than one more list.
The index holds the postings (document, position) of the anchors alone: no other list is ever read.  A phrase's lists are
intersected after taking off the terms' offsets, and the few places that are left are verified against the words of the few
documents that have them.  Near matches may lack some words, so they are looked for at so many of a phrase's rarest terms
that one of them is there, and held against the words around at once: no list of theirs is shuffled.  Only built-in
functions are used.  Texts are shuffled only if the documents with places are too many to be broadcast by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, fresh, joinable, let, settled, stored

#: What stands between words.  Splitting at it is several times faster than extracting the words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms, anchors, phrases and documents up to this number (and BROADCAST_BYTES) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Words that the queries let a near match go beyond a phrase's length on either side.
SLOP = 2
#: How many postings cost as much as a place that must be verified: a further list of a phrase is read if it saves more.
PLACE_COST = 50
#: Words of a document that are looked at in one piece for near matches.
PIECE = 256
PLACES = "array<struct<start:int,size:int,phrase_id:bigint>>"


def words_of(text: Column) -> Column:
    """The words with A-Z lower-cased, in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc, th, pos, term): each word of each document; term is a hash, verified later."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return rows.select("doc", "th", "pos", F.xxhash64("word").alias("term"))


def phrases(benchmark: DataFrame, n: int) -> DataFrame:
    """(phrase, size, items): distinct runs of n words (of a shorter item all its words) and the items they are in."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    runs = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), n).alias("run"))
    return runs.groupBy(F.array_join("run", " ").alias("phrase"), F.size("run").alias("size")).agg(F.collect_set("item").alias("items"))


def _least(size: Column, overlap: float) -> Column:
    """How many of ``size`` distinct words a near match holds at least."""
    return F.ceil(size * overlap - 1e-9)


def _near(docs: DataFrame, table: DataFrame, terms: DataFrame, counts: DataFrame, n: int, slop: int, overlap: float) -> DataFrame:
    """(doc, th, pid, start) where the terms of a phrase are near, still to be verified by words."""
    known = terms.join(counts, "term", "left").select("pid", "size", "off", "word", "term", F.coalesce("count", F.lit(0)).alias("count"))
    ranked = known.withColumn("rank", F.dense_rank().over(Window.partitionBy("pid").orderBy("count", "word")))
    own = terms.groupBy("pid").agg(F.collect_set("term").alias("own"))
    anchors = ranked.join(own, "pid").filter(F.col("rank") <= F.size("own") - _least(F.size("own"), overlap) + 1)
    anchors = stored(anchors.filter("count > 0").select("term", "pid", "off", "size", "own", _least(F.size("own"), overlap).alias("least")), "near-anchors")

    reach = n + 2 * slop
    words = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    cut = words.select("doc", "th", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(PIECE))).alias("from"))
    pieces = cut.select("doc", "th", "from", F.slice("w", F.col("from") + 1, PIECE).alias("part"), F.greatest(F.col("from") - reach, F.lit(0)).alias("base"), F.slice("w", F.greatest(F.col("from") - reach, F.lit(0)) + 1, PIECE + 2 * reach).alias("around"))
    at = pieces.select("doc", "th", "from", "base", "around", F.posexplode("part").alias("pos", "term"))
    met = at.join(joinable(anchors, BROADCAST_ROWS // 10), "term").withColumn("start", F.col("from") + F.col("pos") - F.col("off"))
    first = F.greatest(F.col("start") - slop, F.lit(0)) - F.col("base") + 1
    close = F.size(F.array_intersect(F.slice("around", first, F.col("size") + 2 * slop), F.col("own"))) >= F.col("least")
    return met.filter(close).select("doc", "th", "pid", "start")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _anchors(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, pid, off, size, rank, anchors): the rarest terms of the phrases whose words all occur.

    Two, and a further one where verifying the places at which those before it would meet by chance costs more than its list.
    """
    per_phrase = Window.partitionBy("pid")
    known = terms.join(counts, "term").withColumn("found", F.count("*").over(per_phrase)).filter("found = size")  # else a word is nowhere
    whole = counts.agg(F.coalesce(F.sum("count"), F.lit(1))).first()[0]
    by_rank = per_phrase.orderBy("count", "off")
    chance = F.sum(F.log(F.col("count") / whole)).over(by_rank.rowsBetween(Window.unboundedPreceding, -1)) + F.log(F.lit(float(whole)))
    ranked = known.withColumn("rank", F.row_number().over(by_rank)).withColumn("chance", chance)
    return ranked.filter((F.col("rank") <= 2) | (F.col("chance") + F.log(F.lit(float(PLACE_COST))) > F.log("count"))).withColumn("anchors", F.count("*").over(per_phrase)).select("term", "pid", "off", "size", "rank", "anchors")


def _exact(docs: DataFrame, table: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, th, hits): the documents with exact matches, hits an array of (start, size, phrase_id)."""
    anchors = stored(_anchors(terms, counts), "anchors")
    wanted = joinable(anchors.select("term").distinct(), BROADCAST_ROWS)
    postings = stored(_tokens(docs).join(wanted, "term"), "postings")
    placed = postings.join(joinable(anchors, BROADCAST_ROWS), "term").select("doc", "th", "pid", (F.col("pos") - F.col("off")).alias("start"), "size", "rank", "anchors")
    met = placed.groupBy("doc", "th", "pid", "start").agg(F.countDistinct("rank").alias("lists"), F.first("anchors").alias("anchors"), F.first("size").alias("size"))
    places = met.filter((F.col("lists") == F.col("anchors")) & (F.col("start") >= 0)).select("doc", "th", "pid", "start", "size")
    phrase = table.select("pid", *[h.alias(f"h{i}") for i, h in enumerate(_hashes(F.col("phrase")))])
    of_doc = places.join(joinable(phrase, BROADCAST_ROWS), "pid").groupBy("doc", "th").agg(F.collect_list(F.struct("start", "size", "pid", "h0", "h1")).alias("places"))
    of_doc = stored(of_doc, "places")

    texts = docs.select(F.col("doc_id").alias("id"), "text", _text_hash().alias("own"))
    met = texts.join(joinable(of_doc, BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("th")))

    def verified(words: Column) -> Column:
        def same(p: Column) -> Column:
            h0, h1 = _hashes(F.array_join(F.slice(words, p["start"] + 1, p["size"]), " "))
            return (h0 == p["h0"]) & (h1 == p["h1"])

        return F.transform(F.filter("places", same), lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"), p["pid"].alias("phrase_id")))

    hits = let(words_of(F.col("text")), verified)
    return stored(met.select("doc", "th", hits.alias("hits")).filter(F.size("hits") > 0).dropDuplicates(["doc", "th"]), "hits")


def _hashes(phrase: Column) -> tuple[Column, Column]:
    return F.xxhash64(phrase), F.xxhash64(F.lit("phrase"), phrase)


def _found(docs: DataFrame, benchmark: DataFrame, n: int, slop: int | None, overlap: float) -> DataFrame:
    """(doc, th, hits, items and, with slop, near) of the documents that have any; null where there are none of a kind."""
    table = stored(phrases(benchmark, n).withColumn("pid", F.monotonically_increasing_id()), "phrases")
    terms = table.select("pid", "size", F.posexplode(F.split("phrase", " ")).alias("off", "word")).select("pid", "size", "off", "word", F.xxhash64("word").alias("term"))
    vocabulary = joinable(terms.select("term").distinct(), BROADCAST_ROWS)
    counts = stored(_tokens(docs).select("term").join(vocabulary, "term").groupBy("term").count(), "term-counts")

    exact = _exact(docs, table, terms, counts)
    single = exact.select("doc", "th", F.explode("hits").alias("hit")).select("doc", "th", F.col("hit")["phrase_id"].alias("pid"), F.col("hit")["start"].alias("start"))
    named = single.select("doc", "th", "pid").distinct().join(joinable(table.select("pid", "items"), BROADCAST_ROWS), "pid")
    items = named.select("doc", "th", F.explode("items").alias("item")).groupBy("doc", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    every = exact.unionByName(items, allowMissingColumns=True)
    if slop is not None:
        places = _near(docs, table, terms, counts, n, slop, overlap).distinct()
        same = [places["doc"].eqNullSafe(single["doc"]), *[places[c] == single[c] for c in ("th", "pid", "start")]]
        places = places.join(single, same, "left_anti").join(joinable(table.select("pid", "size"), BROADCAST_ROWS), "pid")
        near = places.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("start", "size", F.col("pid").alias("phrase_id")))).alias("near"))
        every = every.unionByName(near, allowMissingColumns=True)
    return every.groupBy("doc", "th").agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c not in ("doc", "th")])


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int | None = None, overlap: float = 0.8) -> DataFrame:
    """``docs`` with n_words, hits, items and near (columns of these names are replaced).

    hits: exact matches, an array of (start, size, phrase_id), start in words from 0.  items: the items with exact matches,
    sorted as strings.  near: with ``slop``, an array of (start, size, phrase_id) of the places that are no exact match but
    hold, within the phrase's length and ``slop`` words on either side of where one of its rarest terms puts it, at least
    ``overlap`` of its distinct words; else empty.  The rarest terms are so many that no place can lack them all; words that are
    nowhere in the corpus count as rarest, of equally rare ones the first in order comes first.  Words and phrases are compared by
    hashes (phrases: 128 bits).

    docs needs doc_id and text, benchmark item_id and text.  A null text has no words; items without words have no
    phrases; a null item_id names no item; items that repeat share phrases; rows that repeat a doc_id are judged
    by their own text; empty tables are fine; a very long text takes room for its words and one entry for each place;
    other columns pass through.
    """
    rest = [c for c in docs.columns if c.lower() not in ("n_words", "hits", "items", "near")]
    names = ("hits", "items") if slop is None else ("hits", "items", "near")
    own = dict(zip(("doc", "th", "hash", "words", *names), fresh(docs.columns, "doc", "th", "hash", "words", *names), strict=True))
    found = settled("found", lambda: _found(docs, benchmark, n, slop, overlap).select(*[F.col(c).alias(own[c]) for c in ("doc", "th", *names)]))
    whole = docs.select(*rest, _text_hash().alias(own["hash"]), F.size(words_of(F.col("text"))).cast("long").alias(own["words"]))
    met = whole.join(joinable(found, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col(own["doc"])) & (F.col(own["hash"]) == F.col(own["th"])), "left")
    none = {"hits": PLACES, "items": "array<string>", "near": PLACES}
    values = [(F.coalesce(own[c], F.array().cast(kind)) if c in names else F.array().cast(kind)).alias(c) for c, kind in none.items()]
    return met.select(*rest, F.col(own["words"]).alias("n_words"), *values)


def covered(hits: Column) -> Column:
    """How many words lie in any of the hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = F.greatest(acc["end"], h["start"] + h["size"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], h["start"])).alias("n"))

    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["n"])
