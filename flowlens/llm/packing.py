"""Best-fit packing of token sequences by bin completion.

Only the histogram of piece lengths (at most ``capacity`` counts) decides how
pieces combine.  Bin completion takes the largest piece left, enumerates the
undominated fillings of the rest of its sequence, and applies one as often as
the counts allow.  A depth-first branch-and-bound over these choices keeps the
best packing found (first the best-fit one) and prunes a branch once its waste
rules out fewer sequences.  The plan is then dealt to the pieces by their rank
among pieces of equal length, so no piece ever passes through one task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, spread

CAPACITY = 2048
#: Choices that the search tries at most; then its best packing stands.
MAX_NODES = 3_000
#: Fillings that are branched on at a node.
BRANCHES = 3
#: Pieces that are tried for one filling; after so many choices the rest of a branch is packed by best fit, too.
TRIES, FINISH = 400, 16
#: Bases of ranks, one a length and task, that are broadcast at most (about 30 MB).
BASES = 1_000_000
#: Chunks of text whose ids a task remembers; characters it encodes at a time.
CACHE, BATCH_CHARS = 800_000, 2_000_000

# --- tokens ---------------------------------------------------------------

_RUNS = re.compile(r"\s\s|^\s|\s$")


#: Fixed value: the split pattern of the byte-level vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones are
    themselves, the others follow U+0100 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkTokenizer:
    """Token ids of texts, remembering those of frequent chunks.

    The pre-tokenizer never joins a character to a space or line feed before
    it unless the space leads the token, so a text without runs of white space
    may be cut before each of them.  Other texts are encoded whole.  Chunks go
    through tiktoken with the ranks of the tokenizer file itself, which merges
    alike and costs a third a chunk; tests hold both against each other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        symbols = _byte_symbols()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(symbols[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.one = tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seen: dict[str, bytes] = {}

    def _chunk(self, text: str) -> bytes:
        ids = self.one(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes | None] = [None] * len(texts)
        parts: dict[int, list[str]] = {}
        whole = []
        for i, text in enumerate(texts):
            if _RUNS.search(text) or not text:
                whole.append(i)
            else:
                parts[i] = text.replace("\n", " \n").split(" ")
        found = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        for i, e in zip(whole, found, strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        if len(self.seen) > CACHE:
            self.seen.clear()
        for c in set().union(*(p[1:] for p in parts.values())).difference(self.seen):
            self.seen[c] = self._chunk(c if c[0] == "\n" else " " + c)
        get = self.seen.__getitem__
        for i, p in parts.items():
            out[i] = self._chunk(p[0]) + b"".join(map(get, p[1:]))
        return out


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One for a Python worker, so that its tasks share what was remembered."""
    return ChunkTokenizer(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, nth long"


def _pieces(path: str, capacity: int, with_ids: bool):
    end = np.zeros(1, "<u4").tobytes()
    names = [c.split()[0] for c in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = _tokenizer(path), TaskContext.get().partitionId()
        met = [0] * (capacity + 1)

        def cut(texts: list[str], ids: list) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for doc_id, tokens in zip(ids, tokenizer.encode(texts), strict=True):
                tokens += end
                n = len(tokens) // 4
                at, length = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    own = tokens[4 * at : 4 * (at + length)]
                    row = (doc_id, piece, at, length, zlib.crc32(own), own if with_ids else None, task, met[length])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    met[length] += 1
                    at, length = at + length, capacity
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            texts, ids, chars = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.append(text)
                ids.append(doc_id)
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield cut(texts, ids)
                    texts, ids, chars = [], [], 0
            if texts:
                yield cut(texts, ids)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; each document ends with id 0.

    Longer documents are cut so that all but the first piece are full.  ``ids``
    holds the tokens (little-endian unsigned 32-bit) if asked for, else null.
    ``nth`` counts the pieces of equal length that the same ``task`` made before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return spread(rows).mapInArrow(_pieces(tokenizer_path, capacity, with_ids), _PIECES)


# --- bin completion -------------------------------------------------------


@dataclass
class Packing:
    """Fillings (lengths, largest first) with how often each is used."""

    fillings: list[tuple[tuple[int, ...], int]]

    @property
    def bins(self) -> int:
        return sum(m for _, m in self.fillings)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: total length, and large pieces that exclude each other."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    n_from = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    s_from = np.concatenate([np.cumsum((counts * sizes)[::-1])[::-1], [0]])
    half = capacity // 2
    for a in range(0, half + 1):
        n1 = int(n_from[capacity - a + 1])
        n2 = int(n_from[half + 1] - n_from[capacity - a + 1])
        s2 = int(s_from[half + 1] - s_from[capacity - a + 1])
        s3 = int(s_from[a] - s_from[half + 1])
        best = max(best, n1 + n2 + max(0, -(-(s3 - (n2 * capacity - s2)) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first, ``BRANCHES`` at most.

    Fewer, larger pieces dominate a filling that splits them.  So fillings of
    1, 2, 3, ... pieces are tried in turn, as many as fit, and one of more
    pieces counts only if it wastes less.  Sums that n pieces can reach are bits
    of a whole number, got from those of n - 1 pieces by shifts.
    """
    have = [x for x in np.flatnonzero(counts[: room + 1]).tolist() if x]
    if not have:
        return [()]
    mask = (1 << (room + 1)) - 1
    reached, best, found = [1], -1, []
    while best < room and len(reached) <= room // have[0]:
        last, sums = reached[-1], 0
        for x in have:
            sums |= last << x
        reached.append(sums & mask)
        if not reached[-1]:
            break
        n, total = len(reached) - 1, reached[-1].bit_length() - 1
        while total > best:
            own = _compose(counts, have, reached, total, n)
            found += own
            if own:
                best = total
            total = (reached[-1] & ((1 << total) - 1)).bit_length() - 1 if not own else -1
    found.sort(key=lambda f: (room - sum(f), len(f)))
    return found[:BRANCHES] or [()]


def _compose(counts: np.ndarray, have: list[int], reached: list[int], total: int, n: int) -> list[tuple[int, ...]]:
    """Up to ``BRANCHES`` ways to make ``total`` of ``n`` available pieces, largest first, with different largest pieces."""

    def rest(left: int, k: int, most: int, used: tuple[int, ...], tries: list[int]) -> tuple[int, ...] | None:
        if not k:
            return used
        for x in reversed(have[: bisect_right(have, min(most, left))]):
            if x * k < left or not tries[0]:
                return None
            tries[0] -= 1
            if reached[k - 1] >> (left - x) & 1 and used.count(x) < counts[x]:
                made = rest(left - x, k - 1, x, (*used, x), tries)
                if made:
                    return made
        return None

    ways: list[tuple[int, ...]] = []
    most = total
    while len(ways) < BRANCHES:
        made = rest(total, n, most, (), [TRIES])
        if not made:
            break
        ways.append(made)
        most = made[0] - 1
    return ways


def _best_fit(counts: np.ndarray, capacity: int) -> Packing:
    """Largest piece first, then always the largest piece that still fits."""
    left, out = counts.copy(), []
    top = len(left) - 1
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return Packing(out)
        own, room = [top], capacity - top
        left[top] -= 1
        while room:
            have = np.flatnonzero(left[: room + 1])
            if not len(have) or have[-1] == 0:
                break
            own.append(int(have[-1]))
            left[have[-1]] -= 1
            room -= int(have[-1])
        used = np.bincount(own, minlength=len(left))
        times = 1 + min(int(left[x] // used[x]) for x in set(own))
        left -= used * (times - 1)
        out.append((tuple(own), times))


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> Packing:
    """The best packing of ``counts[length]`` pieces that the search finds."""
    incumbent = _best_fit(counts, capacity)
    least = lower_bound(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    stack = [(counts.copy(), (), 0)]  # counts left, fillings so far as a linked list, waste
    nodes = 0
    while stack and nodes < max_nodes and incumbent.bins > least:
        left, path, waste = stack.pop()
        allowed = (incumbent.bins - 1) * capacity - total
        if waste > allowed:
            continue
        nodes += 1
        held = np.flatnonzero(left)
        if not len(held) or nodes % FINISH == 1:
            done = Packing(_unlinked(path) + _best_fit(left, capacity).fillings)
            if done.bins < incumbent.bins:
                incumbent = done
            if not len(held):
                continue
        top = int(held[-1])
        left[top] -= 1
        choices = fillings(left, capacity - top) if top < capacity else [()]
        left[top] += 1
        for f in choices[::-1]:
            own = (top, *f)
            used = np.bincount(own, minlength=len(left))
            times = min(int(left[x] // used[x]) for x in set(own))
            lost = waste + (capacity - sum(own)) * times
            if lost <= allowed:
                stack.append((left - used * times, ((own, times), path), lost))
    return incumbent


def _unlinked(path: tuple) -> list[tuple[tuple[int, ...], int]]:
    found = []
    while path:
        found.append(path[0])
        path = path[1]
    return found[::-1]


def _plan(packing: Packing) -> dict[str, np.ndarray]:
    """Slots of the packing: for each length, ranks from ``key`` on take ``sequence`` on at ``offset``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for own, times in packing.fillings:
        at = 0
        for length in own:
            rank = taken.get(length, 0)
            rows.append(((length << 44) + rank, sequence, at))
            taken[length] = rank + times
            at += length
        sequence += times
    rows.sort()
    key, seq, at = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3
    return {"key": key, "sequence": seq, "offset": at}


def _place(plan: dict[str, np.ndarray]):
    """A column function: sequence and offset of the piece with a length and a rank."""

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        code = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        spot = np.searchsorted(plan["key"], code, side="right") - 1
        return pd.DataFrame({"sequence_id": plan["sequence"][spot] + code - plan["key"][spot], "offset": plan["offset"][spot]})

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset of every piece.

    Null and empty texts are one token, the end.  Repeated rows are packed one
    by one.  An empty table gives an empty result.  Columns other than doc_id
    and text are ignored.  Sequence ids count from 0.  With ids, ids_crc32 is
    that of the ids placed.

    The rank of a piece among those of its length is its number in the task
    that made it plus the counts of the tasks before, so ids stay where they are.
    """
    cut = materialize(pieces(docs, tokenizer_path, capacity, with_ids), "pack-pieces")
    parts = materialize(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = _plan(complete_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = join_small(cut, bases, ["length", "task"], max_rows=BASES).withColumn("place", _place(plan)("length", F.col("base") + F.col("nth")))
    crc = F.crc32("ids") if with_ids else F.col("ids_crc32")
    return ranked.select("doc_id", "piece", "start", "length", crc.alias("ids_crc32"), "ids", "place.sequence_id", "place.offset")
