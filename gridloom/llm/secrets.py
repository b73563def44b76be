"""Secret scans with built-in functions: key patterns, and sliding-window entropy of candidate strings.

Positions come from the pieces between matches: a match starts where the lengths of all earlier pieces and matches
end.  A candidate is a long run over one character class; its windows' Shannon entropy is kept up by incremental
counts: H = log2(w) - S / w with S the sum of c * log2(c), and a character that enters or leaves changes one count.  The
counts of all characters are packed into a few long integers, so that a step is cheap.
Everything is one projection over the documents: no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]{16,})"  # runs are maximal, so a shorter one can't hold a longer match
HEX = r"()([0-9a-f]{24,})"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidates ``run`` of at least ``window`` characters that also match ``must``, and the bits a window needs."""

    name: str
    run: str
    must: str
    bits: float


#: Random text has about 3.4 bits a character in 20 hexadecimal digits and 4.0 in 20 characters of base 64.
CLASSES = (
    CharClass("hex", r"[0-9A-Fa-f]", r"^(?=.*[0-9])(?=.*[A-Fa-f])", 3.0),
    CharClass("base64", r"[A-Za-z0-9+/_=-]", r"^(?=.*[0-9].*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.7),
)
#: Candidates that match one of these are no secrets: those that start or end as placeholders, alphabets, UUIDs.
ALLOW = (
    r"(?i)^(?:example|sample|dummy|placeholder|changeme|your|test[_-])|(?:example|sample|dummy|placeholder|changeme)$",
    r"(?i)^(?:abcdefgh|qwertyui|01234567|12345678)",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
)
WINDOW = 20
#: Characters that what is left of an entropy span beside others has at least.
REST = 8
#: Matches that are walked in one go: their array grows by copying.
CHUNK = 256
_FIRST, _SYMBOLS = ord("+"), ord("z") - ord("+") + 1

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, least: int) -> Column:
    """Spans of all leftmost matches whose group 2 has at least ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_SPAN)

    def walk(parts: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["size"]
            span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(x["good"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(parts, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def in_chunks(parts: Column) -> Column:
        sizes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(CHUNK)), lambda i: F.aggregate(F.slice(parts, i + 1, CHUNK), F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        return let(sizes, lambda own: F.flatten(F.transform(own, lambda _, i: walk(F.slice(parts, i * CHUNK + 1, CHUNK), F.aggregate(F.slice(own, 1, i), F.lit(0), lambda n, x: n + x)))))

    def matched(found: Column) -> Column:
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
        parts = F.transform(zipped, lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("size"), (F.coalesce(F.length(x["value"]), F.lit(0)) >= least).alias("good")))
        return let(parts, lambda p: F.when(F.size(p) <= CHUNK, walk(p, F.lit(0))).otherwise(in_chunks(p)))

    return let(whole, lambda found: F.when(F.size(found) > 0, matched(found)).otherwise(none))


def _xlog(c: int) -> float:
    return c * math.log2(c) if c else 0.0


def _windows(candidate: Column, window: int, bits: float) -> Column:
    """struct(first, last): ends of the first and last window of at least ``bits`` of entropy, 0 if there are none."""
    width = window.bit_length()
    each = 63 // width  # counts in one long
    cells = -(-_SYMBOLS // each)
    gains = F.array(*[F.lit(_xlog(c + 1) - _xlog(c)) for c in range(window + 1)])  # of S when a count of c grows
    codes = F.transform(F.split(candidate, ""), lambda ch: F.ascii(ch) - _FIRST)

    def cell(code: Column) -> Column:
        return F.floor(code / each).cast("int")

    def shift(code: Column) -> Column:
        return (code % each * width).cast("int")

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, cell(code)), shift(code)).bitwiseAND(F.lit((1 << width) - 1)).cast("int")

    def one(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(code))

    def run(codes: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            code, out, i = x["code"], x["out"], x["i"]
            gone = F.when(out.isNull(), F.lit(0.0)).otherwise(F.get(gains, count(acc["counts"], out) + F.when(out == code, 1).otherwise(0) - 1))
            s = acc["s"] + F.get(gains, count(acc["counts"], code)) - gone
            add, take = F.struct(cell(code).alias("at"), one(code).alias("n")), F.struct(cell(out).alias("at"), one(out).alias("n"))
            counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == add["at"], add["n"]).otherwise(0) - F.when(j == take["at"], take["n"]).otherwise(0))
            high = (i + 1 >= window) & (F.lit(math.log2(window)) - s / window >= bits)
            return F.struct(
                counts.alias("counts"), s.alias("s"),
                F.when(high & (acc["first"] == 0), i + 1).otherwise(acc["first"]).alias("first"),
                F.when(high, i + 1).otherwise(acc["last"]).alias("last"),
            )

        start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), cells).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"))
        steps = F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.when(i >= window, F.get(codes, i - window)).alias("out"), i.alias("i")))
        return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(codes, run)


def _entropy_spans(text: Column, kind: CharClass, window: int, allow: Sequence[str]) -> Column:
    """Spans of the windows of high entropy in candidates of one class, those on the allow-list left out."""
    runs = _spans(text, f"()({kind.run}{{{window},}})", KINDS.index("entropy"), window)

    def judged(span: Column) -> Column:
        candidate = F.substr(text, span["start"] + 1, span["end"] - span["start"])

        def of(candidate: Column) -> Column:
            allowed = F.lit(False)
            for pattern in allow:
                allowed = allowed | candidate.rlike(pattern)
            return F.when(candidate.rlike(kind.must) & ~allowed, _windows(candidate, window, kind.bits))

        found = let(candidate, of)
        return let(found, lambda f: F.when(f["first"] > 0, F.struct((span["start"] + f["first"] - window).alias("start"), span["kind"].alias("kind"), (span["start"] + f["last"]).alias("end"))))

    return let(runs, lambda r: F.filter(F.transform(r, judged), lambda s: s.isNotNull()))


def scan(docs: DataFrame, classes: Sequence[CharClass] = CLASSES, window: int = WINDOW, allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (start, kind, end) in code points, end exclusive, ordered.

    base_spans: matches of the patterns.  spans: these and what they leave of the entropy spans, as far as that has REST
    characters (one class's spans come before the next one's).  kind is the place in KINDS.  A null or empty text has
    none; a very long one is scanned whole; columns of these names are replaced, others pass through; rows are treated one by
    one, so repeats and ties don't matter; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c.lower() not in ("base_spans", "spans")]
    none = F.array().cast(_SPAN)
    # whatever but an assignment can match needs a run of so many of these characters: most texts have none
    (likely,) = fresh(docs.columns, "likely")
    least = min(20, window)
    runs = "".join(kind.run for kind in classes)
    known = docs.select(*rest, text.rlike(f"[[A-Z0-9][0-9a-f]{runs}]{{{least}}}").alias(likely))

    def gated(spans: Column) -> Column:
        return F.when(F.col(likely), spans).otherwise(none)

    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 6), gated(_spans(text, ACCESS, 1, 16)), gated(_spans(text, HEX, 2, 24))))
    out = known.select("*", base.alias("base_spans"))
    out = out.withColumn("spans", F.col("base_spans"))
    for kind in classes:
        found = let(_entropy_spans(text, kind, window, allow), lambda new: F.when(F.size(new) > 0, F.array_sort(F.concat("spans", _apart(new, F.col("spans"))))).otherwise(F.col("spans")))
        out = out.withColumn("spans", F.when(F.col(likely), found).otherwise(F.col("spans")))
    return out.select(*rest, "base_spans", "spans")


def _apart(new: Column, old: Column) -> Column:
    """What is left of each new span where the old ones (sorted by start) are taken out."""

    def one(span: Column) -> Column:
        inside = F.filter(old, lambda s: (s["start"] < span["end"]) & (span["start"] < s["end"]))
        start = F.struct(span["start"].alias("at"), F.array().cast(_SPAN).alias("out"))

        def piece(a: Column, b: Column) -> Column:
            return F.when(b - a >= REST, F.array(F.struct(a.alias("start"), span["kind"].alias("kind"), b.alias("end")))).otherwise(F.array().cast(_SPAN))

        def step(acc: Column, s: Column) -> Column:
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"])).alias("out"))

        return F.aggregate(inside, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], span["end"])))

    return F.flatten(F.transform(new, one))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
