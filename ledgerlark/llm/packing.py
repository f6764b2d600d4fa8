"""Packing into windows of 1024 tokens: best-fit decreasing over a segment tree of remaining capacities.

A document is its token ids and one end id.  Overlong documents are first cut
into full windows; what is left of each is a piece of 1 to 1023 tokens.  Best
fit decreasing looks at nothing but lengths, so pieces of one length are placed
together: the plan is made from the 1024 counts of pieces by length (a bounded
table on the driver), and says for each length which ranks go to which windows
and at which offset.  Every piece finds its rank from its rank in its chunk
(counted where it was tokenised) and the chunk's base, a running sum of counts.
The plan is the same as placing all pieces of the corpus one by one in order
of length, and no task holds more than its own pieces.

Cases: a null or empty text is one token (the end id); repeated rows are packed
each; a null doc_id keeps its pieces; a document longer than a window is cut into
full windows and a rest, very long ones within one task; pieces of equal length
are placed in order of their task and row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch
from ledgerlark.llm.wordhash import tidy

WINDOW = 1024
END_ID = 0


class CapacityTree:
    """Numbers of open windows by remaining capacity; finds the least capacity that still fits."""

    def __init__(self, most: int) -> None:
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.total = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.total[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need with an open window."""
        at = need + self.leaves
        if self.total[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.total[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.total[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): rank first + i goes to sequence first + i."""
    tree = CapacityTree(window)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                first, n = sequences, -(-left // (window // length))
                sequences += n
            else:
                first, n = open_runs[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                runs.append((length, rank, full, first, window - capacity + j * length))
                rank += full
            left -= full * each
            leave(capacity - each * length, first, full)
            rest = n - full
            if rest and left:  # fewer pieces than one more window takes
                for j in range(min(left, each)):
                    runs.append((length, rank, 1, first + full, window - capacity + j * length))
                    rank += 1
                used = min(left, each)
                left -= used
                leave(capacity - used * length, first + full, 1)
                leave(capacity, first + full + 1, rest - 1)
            elif rest:
                leave(capacity, first + full, rest)
    return runs


_PLAIN = re.compile("[^\x00-ɏ‐-‧€]")
_TOKENIZERS: dict[str, object] = {}


class Encoder:
    """Token ids of byte-level BPE as the tokenizers library gives them for the JSON file at ``path``.

    Latin text goes through a faster engine that is built from the same file's
    vocabulary; any other text, and any that the engine refuses, through the
    tokenizers library itself.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Byte-level vocabularies write each byte as one printable character.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if text.isascii() or not _PLAIN.search(text):
            try:
                return self.fast.encode(text, allowed_special="all")
            except BaseException as e:  # its engine panics on some texts, beyond Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str | None) -> Encoder:
    """The encoder of a worker; ``path`` None: the installed 50k byte-level vocabulary."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path, public_tokenizers.PATTERN)
    return _TOKENIZERS[path]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk long, rank long"


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, window: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    code = encoder(path)
    chunk, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
    for batch in batches:
        out: list[tuple] = []
        for i, text in enumerate(batch.column("text")):
            ids = np.array([*code.ids(text.as_py() or ""), END_ID], dtype="<u4")
            for lo in range(0, len(ids), window):
                cut = ids[lo : lo + window]
                out.append((i, lo, len(cut), zlib.crc32(cut.tobytes()), len(ids), chunk, int(seen[len(cut)])))
                seen[len(cut)] += 1
        if out:
            cols = [np.array(c, dtype=np.int64) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "rank"])


def _place(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    key, sequence, offset = sent.value
    for batch in batches:
        own = (batch.column("length").to_numpy().astype(np.int64) << 48) | batch.column("rank").to_numpy()
        at = np.searchsorted(key, own, side="right") - 1
        keep = [batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence[at] + (own - key[at])), pa.array(offset[at])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.save(docs.mapInArrow(partial(_pieces, path=tokenizer, window=window), _PIECE), "pieces")
    by_chunk = scratch.save(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "by-chunk")
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.save(by_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "base")
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to the window
    runs = np.array(sorted(plan(counts, window)), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(((runs[:, 0] << 48) | runs[:, 1], runs[:, 3].copy(), runs[:, 4].copy()))
    ranked = pieces.join(base, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "chunk")
    return ranked.mapInArrow(partial(_place, sent=sent), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
