"""Language-model scoring with a weighted backoff automaton.

States are the n-grams of training below order ``ORDER``.  A state has an arc
for every word seen after it and a failure arc to the state of its longest
proper suffix.  One left-to-right traversal of a text carries the state and adds
the log-probabilities up.

Smoothing: a state seen c times gives a word seen c_w times after it the
probability (c_w + K * p) / (c + K), where p is the word's probability in the
failure state, so the failure arc of an unseen word weighs K / (c + K).  These
add up to one after every state, whatever is seen.  The root is a Witten-Bell
unigram model in which an unknown word is one event, that of all new words.

A chunk of texts is read by the part of the automaton that it can reach:
arrays of states, arcs and failure arcs, built from the total counts of the
chunk's n-grams.

Size: every n-gram of every training text counts, the rare ones too; no task
holds them all.  Texts form chunks of ``CHUNK_BYTES``.  A chunk asks the bucket
of each of its different n-grams once, in the order of the keys, and the answer
is the total counts in that order, without keys.  Words have 64-bit hashes as
keys; longer n-grams have as many bits as leave about one in 2^``SPARE_BITS`` a
key that another has, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, spread

#: Longest n-gram, and the counts K that a state lends to its failure state, by length of the state.
ORDER, LENT = 3, (0.0, 500.0, 4.0)
#: Bytes of text in a chunk, and behind a bucket.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
#: Bits of an n-gram's key beyond the logarithm of the number of bytes of all texts.
SPARE_BITS = 16
#: Tokens of a text that are read in one go.
PIECE = 512
#: Word codes that a task remembers.
REMEMBERED = 200_000
#: The end of a text, as a word; no real word is empty.
END = b""


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


# --- n-grams ----------------------------------------------------------------


class Codes(dict):
    """64-bit codes of words, remembering those of recent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return code


def encode(text: str | None, codes: Codes) -> np.ndarray:
    """Codes of the text's tokens, the end included."""
    found = words(text)
    found.append(END)
    return np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))


def _mix(state: np.ndarray, code: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Key of the n-gram that ``code`` makes of the one with key ``state``."""
    x = (state + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) + code
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def key_mask(text_bytes: int) -> np.uint64:
    """The upper bits, whole bytes of them, that keys of n-grams use in a corpus of so many bytes."""
    whole = min(8, -(-(int(text_bytes).bit_length() + SPARE_BITS) // 8))
    return np.uint64((2 ** (8 * whole) - 1) << (64 - 8 * whole))


def ngram_keys(texts: list[np.ndarray], mask: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order n, keys of the n-grams that end at each token of the texts, and where they are real.

    They are not real at the first n - 1 tokens of a text.
    """
    flat = np.concatenate(texts)
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, *(len(t) for t in texts[:-1])])] = True
    real, keys = np.ones(len(flat), bool), flat
    yield keys, real
    for _ in range(1, ORDER):
        real = np.concatenate([[False], real[:-1]]) & ~first
        keys = np.concatenate([np.zeros(1, np.uint64), _mix(keys[:-1], flat[1:], mask)])
        yield keys, real


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, the different ones, and where each begins in that order."""
    order = np.argsort(keys)
    ranked = keys[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ranked[1:] != ranked[:-1]]))
    return order, ranked[begins], begins


def numbered(texts: list[np.ndarray], mask: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the number of the n-gram that ends at each token (-1: none), a token where each ends, and the keys.

    Numbers go by key.
    """
    for keys, real in ngram_keys(texts, mask):
        at = np.flatnonzero(real)
        order, found, begins = _distinct(keys[at])
        ids = np.full(len(keys), -1)
        ids[at[order]] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
        yield ids, at[order[begins]], found


# --- the automaton ------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """The part of the model's automaton that some texts can reach.

    State 0 is the root.  ``root_log`` and ``root_to`` hold its arc for each
    word; an unknown word leads back to it.  Arcs of the other states are sorted
    by ``arcs`` = state * number of words + word (the last one matches nothing).
    A state without an arc for a word passes it on to state ``fail`` at the
    weight ``fail_log``.  Weights are log10.
    """

    root_log: np.ndarray
    root_to: np.ndarray
    arcs: np.ndarray
    arc_log: np.ndarray
    arc_to: np.ndarray
    fail: np.ndarray
    fail_log: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of reading a word in each state, and the state after it."""
        log, to, at = np.zeros(len(word)), np.zeros(len(word), np.int64), state.copy()
        lost = np.flatnonzero(at)
        down = [np.flatnonzero(at == 0)]
        while len(lost):
            wanted = at[lost] * len(self.root_to) + word[lost]
            arc = np.searchsorted(self.arcs, wanted)
            hit = self.arcs[arc] == wanted
            log[lost[hit]] += self.arc_log[arc[hit]]
            to[lost[hit]] = self.arc_to[arc[hit]]
            lost = lost[~hit]
            log[lost] += self.fail_log[at[lost]]
            at[lost] = self.fail[at[lost]]
            down.append(lost[at[lost] == 0])
            lost = lost[at[lost] > 0]
        root = np.concatenate(down)
        log[root] += self.root_log[word[root]]
        to[root] = self.root_to[word[root]]
        return log, to

    def read(self, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The weight of each token of texts that follow one another, each read from left to right.

        Texts are read side by side.  Long ones are cut: a state says no more
        than the last ORDER - 1 tokens, so a piece starts at the root that many
        tokens early and has the state that the whole text leads to.
        """
        ends = np.cumsum(lengths)
        pieces = -(-lengths // PIECE)
        first = np.repeat(ends - lengths, pieces)
        begin = first + PIECE * (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + PIECE, np.repeat(ends, pieces))
        start = np.maximum(first, begin - ORDER + 1)
        longest = np.argsort(start - end)
        begin, start, size = begin[longest], start[longest], (end - start)[longest]
        state, out = np.zeros(len(start), np.int64), np.empty(len(word))
        for i in range(size[0] if len(size) else 0):
            going = np.searchsorted(-size, -i)
            at = start[:going] + i
            log, state = self.step(state[:going], word[at])
            own = at >= begin[:going]
            out[at[own]] = log[own]
        return out


def automaton(ids: list[np.ndarray], where: list[np.ndarray], counts: list[np.ndarray], tokens: int, types: int) -> Automaton:
    """States, arcs and failure arcs of n-grams (see :func:`numbered`) with their counts in training.

    An n-gram that training has is an arc from the state of its first n - 1
    words to the longest state that is a suffix of it; below ORDER that is the
    n-gram itself.  Its probability needs that of the same word in the failure
    state, so orders go upwards.
    """
    whole = float(max(1, tokens + types))
    p = np.where(counts[0] > 0, counts[0] / whole, types / whole if tokens else 1.0)
    own = np.where(counts[0] > 0, np.cumsum(counts[0] > 0), 0)  # state of each n-gram, 0 if it is none
    to, states = own, 1 + int((counts[0] > 0).sum())
    root_log, root_to = np.log10(p), to
    fail, fail_log = [np.zeros(states, np.int64)], [np.zeros(1)]
    arcs, arc_log, arc_to = [], [], []
    for n in range(1, ORDER):
        state, suffix = own[ids[n - 1][where[n] - 1]], ids[n - 1][where[n]]
        seen = counts[n - 1][ids[n - 1][where[n] - 1]]
        fail_log.append(np.log10(LENT[n] / (counts[n - 1][counts[n - 1] > 0] + LENT[n])))
        real = (counts[n] > 0) & (state > 0)
        counts = [*counts[:n], np.where(real, counts[n], 0), *counts[n + 1 :]]
        p = (counts[n] + LENT[n] * p[suffix]) / (seen + LENT[n])
        shorter, own = to[suffix], np.zeros(len(p), np.int64)
        if n + 1 < ORDER:
            own[real] = states + np.arange(int(real.sum()))
            fail.append(shorter[real])
            states += int(real.sum())
        to = np.where(own > 0, own, shorter)
        arcs.append(state[real] * len(root_to) + ids[0][where[n][real]])
        arc_log.append(np.log10(p[real]))
        arc_to.append(to[real])
    order = np.argsort(np.concatenate(arcs))
    return Automaton(
        root_log, root_to, np.append(np.concatenate(arcs)[order], np.iinfo(np.int64).max), np.concatenate(arc_log)[order],
        np.concatenate(arc_to)[order], np.concatenate(fail), np.concatenate(fail_log),
    )


# --- chunks and buckets -----------------------------------------------------


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers by bytes of equal weight, without those that are zero everywhere; the first byte names the others."""
    planes = numbers.view(np.uint8).reshape(-1, 8).T
    used = [i for i in range(8) if planes[i].any()]
    return bytes([sum(1 << i for i in used)]) + b"".join(planes[i].tobytes() for i in used)


def _numbers(packed: bytes, count: int, kind: str) -> np.ndarray:
    planes = np.zeros((count, 8), np.uint8)
    used = [i for i in range(8) if packed[0] >> i & 1]
    for at, i in enumerate(used):
        planes[:, i] = np.frombuffer(packed, np.uint8, count, 1 + at * count)
    return planes.view(kind).ravel()


_ROWS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])
_CHUNK = "chunk long, rows binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK_BYTES or one text more as one compressed Arrow stream, numbered."""
    chunk = key = TaskContext.get().partitionId() << 40
    held: list[pa.RecordBatch] = []
    size = 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        rows = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), rows], ["chunk", "rows"])

    for batch in batches:
        ids = pa.array(np.arange(key, key + batch.num_rows))
        key += batch.num_rows
        made = pa.RecordBatch.from_arrays([ids, *(batch.column(n) for n in ("doc_id", "held_out", "text"))], schema=_ROWS)
        lengths = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            size += n + 8
            if size > CHUNK_BYTES:
                held.append(made.slice(start, i + 1 - start))
                yield packed()
                held, size, start, chunk = [], 0, i + 1, chunk + 1
        if start < made.num_rows:
            held.append(made.slice(start))
    if held:
        yield packed()


def _encoded(rows: bytes, codes: Codes) -> tuple[pa.Table, list[np.ndarray]]:
    table = pa.ipc.open_stream(rows).read_all()
    return table, [encode(t, codes) for t in table.column("text").to_pylist()]


def _bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys."""
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


_ASKED = "bucket int, chunk long, n int, size int, keys binary, counts binary"
_TOLD = "bucket int, chunk long, n int, size int, counts binary, types long, tokens long"


def _ask(buckets: int, mask: np.uint64):
    """For each chunk, bucket and order the different n-grams with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                table, texts = _encoded(rows, codes)
                training = ~np.repeat(table.column("held_out").to_numpy(), [len(t) for t in texts])
                for n, (keys, real) in enumerate(ngram_keys(texts, mask)):
                    order, found, begins = _distinct(keys[real])
                    counts = np.add.reduceat(training[real][order], begins, dtype=np.int64) if len(begins) else np.empty(0, np.int64)
                    del order, begins
                    edges = _bucket_edges(found, buckets)
                    spans = [(b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist()]
                    steps = lambda k: np.concatenate([k[:1], np.diff(k)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b for b, _ in spans], pa.int32()),
                            pa.array([chunk] * len(spans), pa.int64()),
                            pa.array([n] * len(spans), pa.int32()),
                            pa.array([s.stop - s.start for _, s in spans], pa.int32()),
                            pa.array([_planes(steps(found[s])) for _, s in spans], pa.binary()),
                            pa.array([_planes(counts[s]) for _, s in spans], pa.binary()),
                        ],
                        [c.split()[0] for c in _ASKED.split(", ")],
                    )

    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The total counts of what each chunk asks for; one row with the bucket's types and tokens."""
    asked: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "chunk", "n", "size", "keys", "counts")]
        asked += zip(*columns, strict=True)
    names = [c.split()[0] for c in _TOLD.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    for n in range(ORDER):
        own = [a for a in asked if a[2] == n]
        if not own:
            continue
        ends = np.cumsum([a[3] for a in own])
        order, _, begins = _distinct(np.concatenate([np.cumsum(_numbers(a[4], a[3], "<u8"), dtype=np.uint64) for a in own]))
        total = np.add.reduceat(np.concatenate([_numbers(a[5], a[3], "<i8") for a in own])[order], begins)
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(begins, len(order))))
        del order, begins
        for a, begin, end in zip(own, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            row = (a[0], a[1], n, a[3], _planes(each[begin:end]), None, None)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
        if n == 0:
            row = (own[0][0], None, n, 0, None, int((total > 0).sum()), int(total.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(buckets: int, mask: np.uint64, tokens: int, types: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, parts = Codes(), []
        told = {(n, b): (c, size) for n, b, c, size in zip(*(right.column(c).to_pylist() for c in ("n", "bucket", "counts", "size")), strict=True)}
        for rows in left.column("rows").to_pylist():
            table, texts = _encoded(rows, codes)
            ids, where, counts = [], [], []
            for n, (own, ends, _) in enumerate(numbered(texts, mask)):
                ids.append(own)
                where.append(ends)
                counts.append(np.concatenate([_numbers(*told[n, b], "<i8") for b in range(buckets) if (n, b) in told] or [np.empty(0, "<i8")]))
            lengths = np.array([len(t) for t in texts], np.int64)
            score = automaton(ids, where, counts, tokens, types).read(ids[0], lengths)
            known = counts[0][ids[0]]
            del ids, where, counts
            first = np.cumsum(lengths) - lengths
            base = np.log10((known + 1.0) / (tokens + types + 1.0))
            added = lambda x: np.add.reduceat(x, first)
            parts.append(
                pa.table(
                    {
                        "doc_id": table.column("doc_id"),
                        "held_out": table.column("held_out"),
                        "n_tokens": pa.array(lengths),
                        "n_known": pa.array(added((known > 0).astype(np.int64)), pa.int64()),
                        "base_score": pa.array(added(base)),
                        "score": pa.array(added(score)),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    return run


def score_documents(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """Score all texts with a model of those whose fold is not ``held``.

    Null texts are empty: one token, the end.  A null doc_id belongs to the
    training fold.  Repeated rows count and are scored one by one.  Empty
    tables give empty results; without training texts every token is unknown
    with base log10(1/1) = 0 and score 0.  Columns other than doc_id and text
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), parts) == held).alias("held_out"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    chunks = materialize(spread(rows).mapInArrow(_chunked, _CHUNK), "lm-chunks")
    mask = key_mask(size)
    asked = chunks.mapInArrow(_ask(buckets, mask), _ASKED)
    told = materialize(asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_tell, _TOLD), "lm-counts")
    totals = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    answers = told.where(F.col("chunk").isNotNull()).select("chunk", "bucket", "n", "size", "counts")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(buckets, mask, totals["n"], totals["v"]), _SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
