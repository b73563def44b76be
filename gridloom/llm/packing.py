"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens, and a sequence of ``window`` tokens is made of ``window / grain`` grants.  Going
round the queues, the scheduler credits each with its weight; a queue whose credit (its deficit) has come to half a
grant is given one, which is taken off its credit.  So queue s is due its grant k when it has been credited for a
time of ``(2k + 1) / (2 * weight_s)``, and grants go out in the order of these times (ties: in the order of the
queues).  Credits run on over the ends of windows, and a queue is never as much as a grant away from its share
by more than the others' rounding.  A queue that is empty leaves the round and the others share its part.

The number of grants that go out before a given one is a sum of one division for each queue, or for each kind of
queues that have the same weight and number of grants: of these there are few, however many queues.  The state of the round
at any point is thus known without replaying it, and deficits carry over partitions as over windows: a task
only needs the place of its first token in each queue.

Plan: tokenise once into a table of the shared folder (each task also counts its tokens per queue), prefix-sum those
few counts, and cut the stored tokens into pieces.  Tokens are never shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import joinable, stored

#: From more different (weight, grants) of queues on, they are counted in arrays.
FEW_KINDS = 48
BROADCAST_ROWS = 500_000


# ------------------------------------------------------------------------------------------------- the schedule
class Schedule:
    """Where every token of every queue goes.

    totals: tokens of each queue.  weights: whole-number target weights (None: in proportion to what there is,
    so that all queues end together); queues without a weight come last.
    """

    def __init__(self, totals: Sequence[int], weights: Sequence[int] | None = None, window: int = 1024, grain: int = 256):
        if window % grain or window & (window - 1):
            raise ValueError("window must be a power of two and a multiple of grain")
        self.window, self.grain = window, grain
        self.totals = [int(t) for t in totals]
        self.grants = [t // grain for t in self.totals]
        self.weights = self.grants if weights is None else [int(w) for w in weights]
        if any(w < 0 for w in self.weights):
            raise ValueError("weights must not be negative")
        # queues of one weight and number of grants are due at the same times: they are counted together
        alike: dict[tuple[int, int], list[int]] = {}
        for i, (w, n) in enumerate(zip(self.weights, self.grants, strict=True)):
            if w and n:
                alike.setdefault((w, n), []).append(i)
        self.kinds = list(alike)
        self.members = list(alike.values())
        most = (2 * max(self.grants, default=0) + 2) * max(self.weights, default=0)
        self.arrays = None
        if len(self.kinds) > FEW_KINDS and most < 1 << 61:
            flat = np.concatenate([np.array(m) + g * len(self.totals) for g, m in enumerate(self.members)])
            self.arrays = (*np.array(self.kinds, np.int64).T, flat, np.cumsum([0, *map(len, self.members)]))
        self.sides: tuple[int, object] = (-1, None)
        first = sum(n for n, w in zip(self.grants, self.weights, strict=True) if w)
        self.late = []
        for n, w in zip(self.grants, self.weights, strict=True):
            self.late.append(first)
            first += 0 if w else n
        # after all grants come the queues' ends of under a grain, then what is left of the last window becomes
        # sequences whose lengths are powers of two: they need no padding
        self.ends, at = [], first * grain
        for t in self.totals:
            self.ends.append(at)
            at += t % grain
        self.total, self.whole = at, at // window * window
        self.cuts = [self.whole]
        for bit in reversed(range(window.bit_length())):
            if (self.total - self.whole) >> bit & 1:
                self.cuts.append(self.cuts[-1] + (1 << bit))

    def rank(self, queue: int, k: int) -> int:
        """How many grants go out before grant ``k`` of a queue."""
        w = self.weights[queue]
        if not w:
            return self.late[queue] + k
        before, odd, sides = k, 2 * k + 1, self._sides(queue)
        # those due earlier; of those due at the same time, the queues before
        if self.arrays is None:
            for other, n, less, more in sides:
                due = odd * other + w
                before += less * min(due // (2 * w), n) + more * min((due - 1) // (2 * w), n)
            return before
        others, n, *_ = self.arrays
        due = odd * others + w
        return before + int((sides[0] * np.minimum(due // (2 * w), n) + sides[1] * np.minimum((due - 1) // (2 * w), n)).sum())

    def _sides(self, queue: int):
        """How many queues of each kind come before and after a queue."""
        if self.sides[0] == queue:
            return self.sides[1]
        own = (self.weights[queue], self.grants[queue])
        if self.arrays is None:
            out = []
            for (w, n), m in zip(self.kinds, self.members, strict=True):
                less = bisect_left(m, queue)
                out.append((w, n, less, len(m) - less - ((w, n) == own)))
        else:
            others, n, flat, cuts = self.arrays
            less = np.searchsorted(flat, np.arange(len(n)) * len(self.totals) + queue) - cuts[:-1]
            out = (less, np.diff(cuts) - less - ((others == own[0]) & (n == own[1])))
        self.sides = (queue, out)
        return out

    def place(self, queue: int, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before it, length, sequence, offset) for the pieces of ``length`` tokens at ``at`` of a queue."""
        done, grain = 0, self.grain
        main = self.grants[queue] * grain
        runs: list[list[int]] = []  # position, tokens
        while done < length:
            o = at + done
            if o >= main:
                pos, n = self.ends[queue] + o - main, length - done
            else:
                pos, n = self.rank(queue, o // grain) * grain + o % grain, min(grain - o % grain, length - done)
            if runs and sum(runs[-1]) == pos:
                runs[-1][1] += n
            else:
                runs.append([pos, n])
            done += n
        done = 0
        for pos, n in runs:
            while n:
                if pos < self.whole:
                    sequence = pos // self.window
                    start, end = sequence * self.window, (sequence + 1) * self.window
                else:
                    c = bisect_right(self.cuts, pos)
                    sequence, start, end = self.whole // self.window + c - 1, self.cuts[c - 1], self.cuts[c]
                m = min(n, end - pos)
                yield done, m, sequence, pos - start
                done, pos, n = done + m, pos + m, n - m


# ------------------------------------------------------------------------------------------------- the two passes
def _encoder(path: str):
    """(function from a list of texts to a list of id arrays, bytes an id takes) for a tokenizers file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    slow = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    fast = _same_as_ranks(path)
    if fast is None:
        return slow, size

    def encode(texts: list[str]) -> list:
        out = []
        for t in texts:
            if any(s in t for s in special):  # only the tokenizers library knows its special tokens
                out += slow([t])
            else:
                out.append(fast(t))
        return out

    return encode, size


def _same_as_ranks(path: str):
    """tiktoken's encoder for the same vocabulary, where the file has one beside it: same ids at a quarter of the time."""
    import base64
    import os

    beside = path.removesuffix(".json") + ".tiktoken"
    if path == beside or not os.path.exists(beside):
        return None
    import tiktoken
    from public_tokenizers import PATTERN

    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """(pid, doc_id, queue, n, before, ids) with the token ids of every document, ``end_id`` added.

    before: tokens of the same queue earlier in the same task, pid.  ids: little-endian unsigned integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = _encoder(tokenizer_path)
        pid, before = TaskContext.get().partitionId(), {}
        kind = f"<u{size}"
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                queues = part.column("queue").to_pylist()
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [np.asarray([*x, end_id], kind) for x in encode(texts)]
                starts = []
                for q, x in zip(queues, ids, strict=True):
                    starts.append(before.get(q, 0))
                    before[q] = starts[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([pid] * len(ids), pa.int32()),
                        part.column("doc_id").cast(pa.int64()),
                        part.column("queue"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    ["pid", "doc_id", "queue", "n", "before", "ids"],
                )

    return docs.mapInArrow(run, "pid int, doc_id long, queue string, n long, before long, ids binary")


def _queue_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, queue: one queue for each source.  A null source is a queue too."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return docs.select("doc_id", "text", source.alias("queue"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 1024,
    grain: int = 256,
    weights: dict[str, int] | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, sequence_id, offset, doc_tokens, ids_crc32, queue and, with
    ``keep_ids``, ids (array of int).

    docs needs doc_id, text and source; other columns are ignored.  A null or empty text is the end id alone; rows
    that repeat a doc_id are packed as documents of their own; a very long text is tokenised whole and cut into as many pieces
    as it takes; queues that are due at the same time go in the order of their names; an empty table gives no pieces.  grain:
    tokens of a grant, so a window holds the tokens of window / grain grants and is that close to the mixture; smaller grains
    cut documents into more pieces.  weights: whole-number
    target weight of each source (missing: 0, served last); None: as the tokens of the corpus.
    """
    table = stored(tokenize(_queue_key(docs), tokenizer_path), "tokens")
    counts = table.groupBy("pid", "queue").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in counts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    names = sorted(totals)
    shares = None if weights is None else [int(weights.get(q[1:], 0)) if q[0] == "=" else 0 for q in names]
    schedule = Schedule([totals[q] for q in names], shares, window, grain)
    number = {q: i for i, q in enumerate(names)}

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("queue", pa.string())]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512).to_pydict()
                out: list[tuple] = []
                for doc, queue, n, before, base, raw in zip(*(part[c] for c in ("doc_id", "queue", "n", "before", "base", "ids")), strict=True):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    data = memoryview(ids.tobytes())
                    for start, length, sequence, offset in schedule.place(number[queue], base + before, n):
                        row = (doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, sequence, offset, queue)
                        out.append((*row, ids[start : start + length].tolist()) if keep_ids else row)
                columns = list(zip(*out, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    placed = table.join(joinable(bases, BROADCAST_ROWS), ["pid", "queue"])
    return placed.mapInArrow(cut, schema + (", ids array<int>" if keep_ids else ""))
