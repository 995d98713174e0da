"""Best-fit packing of tokenised documents into fixed-length sequences, by large-item matching.

Token counts are integers up to the capacity, so the whole packing is decided on the *histogram* of piece
lengths, which has as many bins as the capacity however large the corpus is:

* pieces above a third of the capacity are matched greedily, at most two in a sequence: the longest open
  piece with the longest other piece that still fits beside it;
* the smaller ones go, longest first, to the fullest sequence whose gap still holds them (best fit), and
  new sequences are opened only when no gap is left.

The plan is a list of patterns (lengths in one sequence) with multiplicities. Pieces are then numbered
within their length - by per-task counts and a prefix sum over tasks, never by sorting a length's pieces in
one task - and the n-th piece of a length takes the n-th place the plan has for it.

Edge cases: a null or empty text is one piece holding only the end token; repeated rows are separate
documents; texts of any length are cut whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.store import Written, ready

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")
#: The split of byte-level BPE before merging, as ``tokenizers`` has it built in.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Ids of ``tokenizers`` for whole texts, as little-endian uint32 bytes.

    Where the file is plain byte-level BPE whose ids rise in the order of its merges, ``tiktoken`` gives the
    same ids in a fifth of the time. Texts holding an added token's string, which the library finds before it
    pre-tokenises, and those with very long runs, for which tiktoken's merging isn't linear, go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        plain = not said.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.fast = self._merger(said["model"]) if plain else None

    def _merger(self, model: dict):
        import tiktoken

        vocab, byte = model["vocab"], _byte_of()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ids = {k: v for k, v in vocab.items() if k not in self.added}
        if model["type"] != "BPE" or model.get("ignore_merges") or merged != sorted(set(merged)) or len(ids) != len(merged) + 256 or min(merged) < 256:
            return None
        coder = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in ids.items()}, special_tokens={})
        return lambda text: array("I", coder.encode_ordinary(text)).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.added) or _LONG_RUN.search(text):
            return self.whole(text)
        return self.fast(text)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece: only documents above the capacity are cut, so that just the first piece can be short.

    ``task`` and ``nth`` say which piece of its length this is within its task.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if not k else capacity
                    rows.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), task, int(seen[size])))
                    seen[size] += 1
                    at, k = at + size, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (piece lengths of a sequence) and how many sequences have each, for a histogram of lengths.

    Deterministic; holds only the histogram and the patterns, a few for each length.
    """
    left = dict(sorted((s, n) for s, n in counts.items() if n))
    patterns: list[tuple[list[int], int]] = []

    def fitting(room: int, over: int) -> int:
        return next((s for s in range(min(room, capacity), over, -1) if left.get(s)), 0)

    third = capacity // 3
    for big in sorted((s for s in left if s > third), reverse=True):
        while left.get(big):
            left[big] -= 1
            mate = fitting(capacity - big, third)
            left[big] += 1
            n = left[big] if not mate else left[big] // 2 if mate == big else min(left[big], left[mate])
            patterns.append(([big, mate] if mate else [big], n))
            left[big] -= n
            if mate:
                left[mate] -= n
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    for p, n in patterns:
        gaps.setdefault(capacity - sum(p), []).append((p, n))
    for small in sorted((s for s in left if s <= third), reverse=True):
        need = left[small]
        while need:
            gap = next((g for g in range(small, capacity) if gaps.get(g)), None)
            if gap is None:
                each = capacity // small
                full, rest = divmod(need, each)
                for size, n in ((each, full), (rest, 1)):
                    if size and n:
                        gaps.setdefault(capacity - size * small, []).append(([small] * size, n))
                break
            p, n = gaps[gap].pop()
            fits = gap // small
            take = min(n, need // fits)
            if take:
                gaps.setdefault(gap - fits * small, []).append((p + [small] * fits, take))
                need -= take * fits
            elif need:
                take = 1
                gaps.setdefault(gap - need * small, []).append((p + [small] * need, 1))
                need = 0
            if n > take:
                gaps[gap].append((p, n - take))
    return sorted((sorted(p, reverse=True), n) for v in gaps.values() for p, n in v)


def places(patterns: list[tuple[list[int], int]], capacity: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first number of a run of its pieces, the sequence of that one, and the offset there."""
    taken = [0] * (capacity + 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in taken]
    base = 0
    for p, n in patterns:
        at = 0
        for s in p:
            out[s].append((taken[s], base, at))
            taken[s] += n
            at += s
        base += n
    return [tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) if x else (np.zeros(0, np.int64),) * 3 for x in out]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack ``docs`` (doc_id, text): per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tokenises once. Sequences hold at most ``capacity`` tokens and fill gapless from offset 0.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = Written(tokenized(docs, tokenizer, capacity, end_id), "pieces").df
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = Written(by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "firsts").df
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for b in batches:
            size, nth = (b.column(k).to_numpy() for k in ("length", "number"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                first, base, at = runs[s]
                of = np.flatnonzero(size == s)
                k = np.searchsorted(first, nth[of], "right") - 1
                seq[of], off[of] = base[k] + nth[of] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.join(firsts.select("task", "length", "first"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, PLACED)
