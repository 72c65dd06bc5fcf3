"""Alignment of two tokenizers' tokens over the same bytes.

Every token of either tokenizer ends at a byte offset.  The end events of both,
united, are repartitioned by document and sorted by offset within the
partitions; a machine reads them in that order.  It keeps the group that is open
and running totals of the document, and closes a group at every offset where a
token of either side ends.

Events travel in rows of at most ``SPAN`` bytes of text and one side, as packed
token lengths and ids, so that an event takes three or four bytes in the shuffle
and a very long document is read in pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, materialize, shuffle_partitions, spread
from .packing import BATCH_CHARS, _byte_symbols, _tokenizer

#: Bytes of text whose events make one row.
SPAN = 1 << 15
#: Classes of linked ids that are broadcast at most (some 60 MB); beyond, they are joined by key.
LINK_CLASSES = 1_000_000
#: Shuffle partitions for each partition of the input: events take about as many bytes as their text and sort in memory.
FAN_OUT = 2

_GAP = re.compile(r"\s{1000}")

# --- the two sides ----------------------------------------------------------


class Side:
    """A tokenizer and the bytes of its entries."""

    def __init__(self, entries: list[bytes]):
        self.bytes = entries

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of a space and each text."""
        raise NotImplementedError

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of a space and each text; None for null and empty texts and where the tokens' bytes are others."""
        out: list[np.ndarray | None] = [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t]
        for i, ids in zip(known, self.ids([texts[i] for i in known]) if known else (), strict=True):
            if b"".join(map(self.bytes.__getitem__, ids)) == (" " + texts[i]).encode("utf-8", "surrogatepass"):
                out[i] = np.array(ids, "u4")
        return out


class ByteSide(Side):
    """Tokens of a byte-level vocabulary file; the text is given a space before it.

    They come from tiktoken with the ranks of the file itself, which merges
    alike and takes a third of the time; tests hold both against each other.
    Texts with a long run of white space go through the file's own library.
    """

    def __init__(self, path: str):
        self.model = _tokenizer(path)
        symbols = _byte_symbols()
        vocab = self.model.tokenizer.get_vocab()
        entries = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            if all(c in symbols for c in entry):
                entries[i] = bytes(symbols[c] for c in entry)
        super().__init__(entries)

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        for t in texts:
            yield self.model.tokenizer.encode(" " + t, add_special_tokens=False).ids if _GAP.search(t) else self.model.one(" " + t)


class PieceSide(Side):
    """Pieces of a sentence-piece model, which sets a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        return iter(self.model.encode(texts, num_threads=1))


@lru_cache(maxsize=4)
def _side(path: str) -> tuple[Side, np.ndarray]:
    """The tokenizer of a file and the bytes of each of its ids, one for a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    side = PieceSide(path) if path.endswith(".model") else ByteSide(path)
    return side, np.array([len(b) for b in side.bytes], "<u2")


# --- events -----------------------------------------------------------------

_EVENTS = "doc long, doc_id long, span long, side int, valid boolean, first long, n int, lengths binary, ids binary"
_EVENT_TYPES = pa.schema(
    [("doc", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64()), ("side", pa.int32()), ("valid", pa.bool_()), ("first", pa.int64())]
    + [("n", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary())]
)


def _packed(numbers: np.ndarray) -> bytes:
    """One, two or four bytes a number, as the largest needs."""
    most = int(numbers.max())
    return numbers.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64)


def _events(paths: tuple[str, ...], span: int):
    """For each text and side, rows of the events that end in each span of bytes; one row without events at least."""

    def rows(doc: int, doc_id: int | None, side: int, ids: np.ndarray | None, widths: np.ndarray) -> Iterator[tuple]:
        if ids is None:
            yield doc, doc_id, 0, side, False, 0, 0, b"", b""
            return
        lengths = widths[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        of = (ends - 1) // span
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            yield doc, doc_id, int(of[a]), side, True, int(ends[a] - lengths[a]), int(b - a), _packed(lengths[a:b]), _packed(ids[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            whole = batch.column("text").to_pylist()
            doc_ids = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(whole):
                stop, chars = at, 0
                while stop < len(whole) and (stop == at or chars + len(whole[stop] or "") <= BATCH_CHARS):
                    chars += len(whole[stop] or "")
                    stop += 1
                texts = whole[at:stop]
                out: list[tuple] = []
                for side, path in enumerate(paths):
                    tokenizer, widths = _side(path)
                    for i, ids in enumerate(tokenizer.encode(texts)):
                        out += rows(task << 33 | nth + i, doc_ids[at + i], side, ids, widths)
                nth += stop - at
                at = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _EVENT_TYPES.types, strict=True)], schema=_EVENT_TYPES)

    return run


def end_events(docs: DataFrame, paths: tuple[str, ...], span: int = SPAN) -> DataFrame:
    """The end events of every text under each tokenizer, united; ``doc`` numbers the rows of ``docs``.

    ``valid`` is false where the tokens' bytes are not a space and the text, and
    for null and empty texts.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(_events(paths, span), _EVENTS)


# --- the sweep --------------------------------------------------------------

_SWEPT = "doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_SWEPT_TYPES = pa.schema(
    [("doc", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
_NONE = np.empty(0, np.int64)


@lru_cache(maxsize=2)
def _words(limit: int) -> list[bytes]:
    """Ids in decimal, each after a semicolon, a bar and a comma: three tables in one."""
    return [mark + str(i).encode() for mark in (b";", b"|", b",") for i in range(limit)]


class Sweep:
    """The state for one document: its totals, the hash of its closed groups, and the events of the open one."""

    def __init__(self, doc: int, doc_id: int | None, limit: int = 1 << 16):
        self.doc, self.doc_id, self.limit = doc, doc_id, limit
        self.valid, self.n, self.groups = True, [0, 0], 0
        self.hash, self.open = hashlib.sha256(), [(_NONE, _NONE), (_NONE, _NONE)]

    def read(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Take the events (ends and ids) of one span of both sides; returns the linked pairs and how often each is."""
        self.n[0] += len(a[0])
        self.n[1] += len(b[0])
        (ends_a, ids_a), (ends_b, ids_b) = ((np.concatenate([x, y]) for x, y in zip(o, s, strict=True)) for o, s in zip(self.open, (a, b), strict=True))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(common):
            self.open = [(ends_a, ids_a), (ends_b, ids_b)]
            return _NONE, _NONE
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        n_a, n_b = int(last_a[-1]) + 1, int(last_b[-1]) + 1
        self.open = [(ends_a[n_a:], ids_a[n_a:]), (ends_b[n_b:], ids_b[n_b:])]
        self._digest(ids_a[:n_a], ids_b[:n_b], last_a, last_b)
        self.groups += len(common)
        return np.unique(ids_a[last_a] << 32 | ids_b[last_b], return_counts=True)

    def _digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Hash the closed groups: the ids of both sides merged by group, each after its mark."""
        first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
        at_a = np.arange(len(a)) + np.repeat(first_b, last_a - first_a + 1)
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, last_b - first_b + 1)
        limit = max(self.limit, int(a.max()) + 1, int(b.max()) + 1)
        self.limit = 1 << (limit - 1).bit_length()
        out = np.empty(len(a) + len(b), np.int64)
        comma = 2 * self.limit
        out[at_a], out[at_b] = a + comma, b + comma
        out[at_a[first_a]] -= comma
        out[at_b[first_b]] -= self.limit
        text = b"".join(map(_words(self.limit).__getitem__, out.tolist()))
        self.hash.update(text if self.groups else text[1:])

    def totals(self) -> tuple:
        if not self.valid:
            return self.doc, self.doc_id, 0, 0, 0, 0, ""
        return self.doc, self.doc_id, *self.n, self.groups, self.groups, self.hash.hexdigest()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each document's links, span by span, the last with its totals."""
    state: Sweep | None = None
    span, held = -1, [(_NONE, _NONE), (_NONE, _NONE)]
    out: list[tuple] = []

    def end_span() -> tuple[np.ndarray, np.ndarray]:
        pairs = state.read(*held) if state.valid else (_NONE, _NONE)
        held[:] = [(_NONE, _NONE), (_NONE, _NONE)]
        return pairs

    def closed() -> tuple:
        links = end_span()
        return *state.totals(), *links

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SWEPT_TYPES.types, strict=True)], schema=_SWEPT_TYPES)

    for batch in batches:
        for doc, doc_id, own, side, valid, first, n, lengths, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or doc != state.doc:
                if state is not None:
                    out.append(closed())
                state, span = Sweep(doc, doc_id), own
            elif own != span:
                pairs, times = end_span()
                if len(pairs):
                    out.append((doc, None, None, None, None, None, None, pairs, times))
                span = own
            state.valid &= valid
            if n:
                held[side] = (first + np.cumsum(_unpacked(lengths, n)), _unpacked(ids, n))
        if out:
            yield batch_of(out)
            out = []
    if state is not None:
        yield batch_of([closed()])


def sweep(events: DataFrame) -> DataFrame:
    """Groups and links of every document of ``events``: totals in one row, links (A id << 32 | B id, and how often) in one or more.

    A document in which either side's tokens do not give its bytes has zeros.
    """
    n = max(shuffle_partitions(events.sparkSession), FAN_OUT * events.rdd.getNumPartitions())
    return events.repartition(n, "doc").sortWithinPartitions("doc", "span", "side").mapInArrow(_sweep, _SWEPT)


# --- links corpus-wide ------------------------------------------------------


def link_classes(links: DataFrame) -> DataFrame:
    """For each linked pair its count, the rows that hold it, and whether none is more frequent with its B id."""
    found = materialize(links.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("n")), "link-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = found.groupBy(b).agg(F.max("count").alias("most"))
    return materialize(found.withColumn("b", b).join(most, "b").select("pair", "n", "count", (F.col("count") == F.col("most")).alias("best")), "link-classes")


def align(docs: DataFrame, path_a: str, path_b: str, span: int = SPAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    Null and empty texts, and texts that either tokenizer changes, have zeros
    and an empty string, and add no links.  Repeated rows are aligned and
    counted one by one.  Rows without doc_id keep a row.  An empty table gives
    an empty result.  Columns other than doc_id and text are ignored.

    Only the group that is open is held back, so what a task holds is bounded
    by ``span`` and by the longest stretch of text in which the two tokenizers
    never end together.
    """
    swept = materialize(sweep(end_events(docs, (path_a, path_b), span)), "alignment")
    links = swept.where(F.size("pairs") > 0).select("doc", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("doc", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    classes = link_classes(links)
    if classes.limit(LINK_CLASSES + 1).count() <= LINK_CLASSES:
        told = links.join(F.broadcast(classes), "pair")
    else:
        told = join_by_count(links, classes, ["pair"])
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    sums = told.groupBy("doc").agg(best, F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    whole = swept.where("n_a is not null").drop("pairs", "times")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.join(sums, "doc", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
