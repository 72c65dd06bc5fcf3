"""Document fingerprints by Order MinHash.

Every k-mer of a text is numbered by its occurrence.  Each of ``SLOTS`` random
permutations selects its two minimal numbered k-mers; they are put back
into text order and the tuple is hashed.  Two texts agree in a slot about as
often as their edit distance is small, since both the k-mers and their order
must match.  A fingerprint is the slots' 16-bit hashes in hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Code points of a k-mer, permutations, k-mers a permutation selects (two).
KMER, SLOTS = 10, 64
#: Numbers of the slot-by-k-mer table that are held at once.
BLOCK = 1 << 19

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLOT_RNG = np.random.RandomState(20)
_SLOT_A = (_SLOT_RNG.randint(0, 1 << 31, SLOTS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def numbered_kmers(text: str, k: int = KMER) -> np.ndarray:
    """64-bit hashes of the k-mers with their occurrence numbers, in text order.

    A text shorter than ``k`` counts as one k-mer; the empty text too.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - k + 1
    if n < 1:
        points, n = np.concatenate([points + np.uint64(1), np.zeros(k - len(points), np.uint64)]), 1
    h = _windows(points, k)
    # Only k-mers that may repeat are ordered: counts of their low bits find them.
    bits = max(12, (4 * n).bit_length())
    low = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    at = np.flatnonzero((np.bincount(low, minlength=1 << bits) > 1)[low])
    if not len(at):
        return h
    some = h[at]
    order = np.argsort(some, kind="stable")
    s = some[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    number = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    later = number > 0
    h[at[order[later]]] = _mix(s[later] + number[later].astype(np.uint64) * _ROLL)
    return h


def _windows(points: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all runs of ``k`` points, put together from runs of powers of two."""
    total, have, run, width = None, 0, points, 1
    while True:
        if k & width:
            n = len(points) - have - width + 1
            total = run[:n] if total is None else total[:n] * _ROLL + run[have : have + n]
            have += width
        if have == k:
            return _mix(total)
        n = len(run) - width
        run = (run[:n] * _MIX1) ^ (run[width:] + _MIX2)
        run ^= run >> np.uint64(29)
        width *= 2


def sketch(text: str) -> np.ndarray:
    """``SLOTS`` uint16 values; equal texts have equal sketches."""
    full = numbered_kmers(text)
    x = (full >> np.uint64(32)).astype(np.uint32)
    n, out = len(x), np.empty(SLOTS, np.uint16)
    step = max(1, BLOCK // n)
    for at in range(0, SLOTS, step):
        v = x[None, :] * _SLOT_A[at : at + step, None]
        rows = np.arange(len(v))
        p = v.argmin(axis=1)
        if n > 1:
            v[rows, p] = np.uint32(0xFFFFFFFF)
            q = v.argmin(axis=1)
            q = np.where(q == p, (p + 1) % n, q)
        else:
            q = p
        low, high = np.minimum(p, q), np.maximum(p, q)
        pair = _mix(full[low] * _ROLL + full[high])
        out[at : at + step] = (pair >> np.uint64(48)).astype(np.uint16)
    return out


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


_FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(doc_id: int, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = sketch(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, _hex(own), _hex(other), likeness(own, other), likeness(own, after)


def _ordered_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order; each is compared with the one after it.

    The first and the last text of a partition go along (``edge`` F or L) for
    the comparison across partitions.
    """
    columns = [*_FIELDS, "part", "edge", "text"]
    held, part = None, None
    for batch in batches:
        rows = []
        for doc_id, text, p in zip(batch["doc_id"], batch["text"], batch["part"], strict=True):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            own = sketch(text)
            if held is None:
                part = int(p)
                rows.append((doc_id, None, None, None, None, None, None, part, "F", text))
            else:
                rows.append((*_compared(*held, text, own), part, None, None))
            held = (doc_id, text, own)
        yield _frame(rows, columns)
    if held is not None:
        yield _frame([(held[0], None, None, None, None, None, None, part, "L", held[1])], columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({"doc_id": "Int64", "n_chars": "Int64", "part": "int32", "near_edited": "float64", "near_next": "float64"})


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            _compared(None if pd.isna(d) else int(d), t, sketch(t), f, sketch(f))
            for d, t, f in zip(batch["doc_id"], batch["text"], batch["following"], strict=True)
        ]
        out = pd.DataFrame(rows, columns=list(_FIELDS))
        yield out.astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": "float64", "near_next": "float64"})


def fingerprint_chain(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edit with the next document's text.

    The next document has the next smaller doc_id (ties: by a hash of the text,
    then the text; null ids come last); after the last comes the first, so a lone document follows itself.
    Null texts are empty.  Repeated rows are all kept.  An empty table gives an
    empty result.  Columns other than doc_id and text are ignored.

    Texts cross the network once, into ranges of doc_id and the text's hash, so
    ranges are found without texts; only the first and last text of every range
    are handed on.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("hash")]
    ranged = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    placed = ranged.withColumn("part", F.spark_partition_id())
    done = materialize(
        placed.mapInPandas(_ordered_rows, SCHEMA + ", part int, edge string, text string"), "order-minhash"
    )
    inner = done.where(F.col("edge").isNull()).select(*_FIELDS)
    firsts = done.where("edge = 'F'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = done.where("edge = 'L'").select("part", "doc_id", "text")
    parts = lasts.select("part")  # one row a partition
    chain = parts.withColumn("next_part", F.lead("part").over(Window.orderBy("part"))).withColumn(
        "next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy(F.lit(1))))
    )
    pairs = lasts.join(chain, "part").join(firsts, "next_part").select("doc_id", "text", "following")
    return inner.unionByName(pairs.mapInPandas(_edges, SCHEMA))
