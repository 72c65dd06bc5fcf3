"""Line deduplication over a suffix array of line ids.

A document is the sequence of the ids of its non-blank lines; the corpus is all
of these.  Prefix doubling sorts its suffixes: ranks by the first line come
from sorting the ids, and ranks by the first 2^(k+1) lines from sorting the
pairs of ranks, by the first 2^k lines, of a suffix and of the one 2^k lines
after it.  Every round is a grouping, a range sort of the groups, and a join, all
distributed.  A suffix whose rank is its own has its place in the array and
leaves the rounds, so these hold repeated runs only, and stop when the longest
has been passed.

Suffixes that share a rank of round k are an interval of the suffix array whose
longest common prefixes have 2^k lines or more.  Its earliest place is the
original, the others begin later copies.  A maximal repeated run of n lines
(2^k <= n < 2^(k+1)) is the union of its first and last 2^k lines, both of
them later copies in round k, so the union of what the rounds find is the union
of the maximal repeated runs.  Short runs may pass ``min_words`` words between
two powers of two only; for these, lengths up to ``min_words`` lines are ranked too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_count, materialize, shuffle_partitions, spread

#: Words that a repeated run needs to be deleted.
MIN_WORDS = 5
#: Lines that a task passes on at a time.
FLUSH = 50_000


def _sequence(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """Line numbers, ids and word counts of the non-blank lines."""
    numbers, ids, counts = [], [], []
    for i, line in enumerate(text.split("\n")):
        raw = line.encode("utf-8", "surrogatepass")
        n = len(raw.split())
        if n:
            numbers.append(i)
            ids.append(xxhash.xxh3_128_digest(raw.strip()))
            counts.append(n)
    return numbers, ids, counts


def odd_runs(counts: list[int], min_words: int = MIN_WORDS) -> dict[int, list[int]]:
    """By first line, the lengths that are no power of two of the shortest runs with ``min_words`` words from or up to a line.

    They depend on the lines of the run alone, so copies of a run agree.
    """
    if not counts or min(counts) >= min_words:
        return {}
    before = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    stop = np.searchsorted(before, before[:-1] + min_words)  # shortest run from each line, if it is n or less
    start = np.searchsorted(before, before[1:] - min_words, side="right") - 1  # shortest up to each line, if not negative
    runs = {(i, int(e) - i) for i, e in enumerate(stop) if e <= n} | {(int(b), i + 1 - int(b)) for i, b in enumerate(start) if b >= 0}
    out: dict[int, list[int]] = {}
    for i, length in sorted(runs):
        if length & (length - 1):
            out.setdefault(i, []).append(length)
    return out


_LINES = "doc_id long, key long, i int, line binary, odd array<int>"


def _lines(min_words: int):
    names = [c.split()[0] for c in _LINES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                _, ids, counts = _sequence(text or "")
                odd = odd_runs(counts, min_words)
                rows += [(doc_id, key, i, line, odd.get(i)) for i, line in enumerate(ids)]
                if len(rows) > FLUSH:
                    yield packed()
                    rows = []
        yield packed()

    return run


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key", "i")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """The groups of ``rows`` with more than one row: earliest place, size, and a rank that rises with ``by``."""
    groups = rows.groupBy(*by).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    n = shuffle_partitions(rows.sparkSession)
    ordered = groups.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return materialize(ordered.withColumn("new", F.monotonically_increasing_id()), "line-ranks")


def _refined(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """Suffixes of ``rows`` (stored) that share their ``by`` with others: their new rank, and whether they are later copies."""
    shared = join_by_count(rows, _ranked(rows, by), by)
    if shared is None:
        return None
    return shared.select("doc_id", "key", "i", "odd", F.col("new").alias("rank"), (_place() != F.col("first")).alias("later"))


def _pairs(suffixes: DataFrame, step: int) -> DataFrame:
    """Suffixes with the rank of the one ``step`` lines after them, where that has one."""
    after = Window.partitionBy("doc_id", "key").orderBy("i").rangeBetween(step, step)
    return suffixes.select("doc_id", "key", "i", "odd", "rank", F.max("rank").over(after).alias("next")).where("next is not null")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, start and lines of runs that copy an earlier place; with at least the lines of every maximal one.

    Runs count non-blank lines.  Runs with fewer than ``min_words`` words may be among them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("key"), "text")
    lines = materialize(spread(rows).mapInArrow(_lines(min_words), _LINES), "lines")
    found = _refined(lines, ["line"])
    runs = lines.select("doc_id", "key", F.col("i").alias("start"), F.lit(1).alias("lines")).where("false")
    lengths = [n for n in range(3, min_words + 1) if n & (n - 1)]
    step = 1
    while found is not None:
        if step == 1:  # rows that repeat both id and text are one sequence
            found = found.groupBy("doc_id", "key", "i", "rank", "later").agg(F.first("odd").alias("odd"))
        suffixes = materialize(found, "suffixes")
        runs = runs.unionByName(suffixes.where("later").select("doc_id", "key", F.col("i").alias("start"), F.lit(step).alias("lines")))
        for n in lengths:
            if step < n < 2 * step and suffixes.where(F.array_contains("odd", n)).limit(1).count():
                own = _refined(materialize(_pairs(suffixes, n - step).where(F.array_contains("odd", n)), "suffix-pairs"), ["rank", "next"])
                if own is not None:
                    runs = runs.unionByName(own.where("later").select("doc_id", "key", F.col("i").alias("start"), F.lit(n).alias("lines")))
        found = _refined(materialize(_pairs(suffixes, step), "suffix-pairs"), ["rank", "next"])
        step *= 2
    return runs


def _cut_text(text: str | None, cuts: list | None, min_words: int = MIN_WORDS) -> tuple[str | None, list[tuple[int, int]]]:
    """The text without the lines of the cuts of at least ``min_words`` words; the spans cut as (first line, one past the last)."""
    if text is None or cuts is None or not len(cuts):
        return text, []
    numbers, _, counts = _sequence(text)
    before = np.concatenate([[0], np.cumsum(counts)])
    edges = np.zeros(len(numbers) + 1, np.int64)
    for c in cuts:
        stop = min(len(numbers), c["start"] + c["lines"])
        if before[stop] - before[c["start"]] >= min_words:
            edges[c["start"]] += 1
            edges[stop] -= 1
    gone = {numbers[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] > 0)}
    left = [x for i, x in enumerate(text.split("\n")) if i not in gone]
    spans: list[tuple[int, int]] = []
    for i in sorted(gone):
        if spans and spans[-1][1] == i:
            spans[-1] = (spans[-1][0], i + 1)
        else:
            spans.append((i, i + 1))
    return ("\n".join(left) if len(gone) < len(numbers) else "" if gone else text), spans


def _cut_all(min_words: int):
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        done = [_cut_text(t, c, min_words) for t, c in zip(texts, cuts, strict=True)]
        return pd.DataFrame({"text": [t for t, _ in done], "spans": [[{"first": a, "stop": b} for a, b in s] for _, s in done]})

    return F.pandas_udf(cut, "text string, spans array<struct<first:int,stop:int>>")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, into: str = "removed_lines") -> DataFrame:
    """``docs`` with later copies of line runs deleted, and their spans in the column ``into``.

    A line goes if it lies in a run of consecutive non-blank lines, of at least
    ``min_words`` words in all, that also starts at an earlier place.  Places
    are ordered by doc_id (null last) and line; lines compare without white
    space at their ends.  Blank lines stay, unless nothing else is left: then
    the text is empty.  Null texts stay null.  Rows that repeat both id and
    text count as one and are cut alike.  An empty table gives an empty result.
    Other columns are kept; ``into`` replaces a column of that name.
    """
    base = docs.drop(into)
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__row")  # so that no column's name clashes
    runs = repeated_runs(docs, min_words)
    cuts = runs.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list(F.struct("start", "lines")).alias("__cuts"))
    keyed = base.select(row, _row_key().alias("__key0"))
    same = (F.col("__key0") == F.col("__key")) & F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__id"))
    joined = keyed.join(cuts, same, "left").withColumn("__done", _cut_all(min_words)(F.col("__row.text"), F.col("__cuts")))
    kept = [(F.col("__done.text") if c == "text" else F.col("__row")[c]).alias(c) for c in base.columns]
    return joined.select(*kept, F.col("__done.spans").alias(into))
