"""Which filter removes what, in every order of five filters.

Every document is reduced to the set of filters that it fails, a mask.  Counts
by part and mask are all that the audit needs.  They give each part's removal
polynomial: the multilinear extension of the number of documents that a set of
filters removes, as coefficients of products of the filters' variables.  Its
corners tell what any sequence of filters has removed, and the integral of its
partial derivative along the diagonal, in exact fractions, is a filter's Shapley
value; 120 times that is what it removes in all orders together.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, materialize, spread

FILTERS = "ABCDE"
#: The filter that needs the whole table: a copy of an earlier text.
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Words at least, percent of distinct words at least, percent of capitals at most.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2


def row_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself, the first filter's lowest."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and for each mask the documents, those of quality 1 and those that are toxic: three arrays of 32 counts.

    A copy is a text that a smaller doc_id has, too.  Rows without doc_id are
    neither copies nor originals, and bear no labels.  Of several labels of a
    document, the highest counts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))).select(
            "doc_id", "part", row_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
        ),
        "filter-masks",
    )
    known = rows.where("doc_id IS NOT NULL")
    groups = known.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    groups = materialize(groups, "filter-copies")
    found = join_by_count(known, groups, ["digest"])
    own = rows.select("doc_id", "part", "mask", F.lit(1).alias("times"))
    if found is not None:  # copies move from one mask to another
        copies = materialize(found.where("doc_id > first").select("doc_id", "part", "mask"), "filter-copy-rows")
        own = own.unionByName(copies.withColumn("times", F.lit(-1))).unionByName(
            copies.select("doc_id", "part", (F.col("mask") + COPY).alias("mask"), F.lit(1).alias("times"))
        )
    by = own.groupBy("part", "mask").agg(F.sum("times").alias("docs")).select("part", "mask", "docs", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    if labels is not None:
        one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
        marks = labels.where("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
        marked = own.join(marks, "doc_id").groupBy("part", "mask").agg(F.sum(F.col("times") * F.col("good")).alias("good"), F.sum(F.col("times") * F.col("toxic")).alias("toxic"))
        by = by.unionByName(marked.select("part", "mask", F.lit(0).alias("docs"), "good", "toxic"))
    counted = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).cast("long") for m in range(MASKS)]).alias(c)
    return by.groupBy("part").agg(*[counted(c) for c in ("docs", "good", "toxic")])


def removal_polynomial(counts: list[int], n: int = len(FILTERS)) -> list[int]:
    """Coefficients, by the set of variables, of the multilinear extension of what sets of filters remove.

    A set removes the documents whose mask it meets.  The corner values become
    coefficients by Moebius inversion, one variable after another.
    """
    out = [sum(c for mask, c in enumerate(counts) if mask & s) for s in range(1 << n)]
    for i in range(n):
        for s in range(1 << n):
            if s >> i & 1:
                out[s] -= out[s ^ 1 << i]
    return out


def at_corner(polynomial: list[int], s: int) -> int:
    """Value where the variables of the set are 1 and the others 0."""
    return sum(c for t, c in enumerate(polynomial) if t & s == t)


def shapley_value(polynomial: list[int], i: int) -> Fraction:
    """Integral over the diagonal of the partial derivative by variable ``i``."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0))


def audit(docs: list[int], good: list[int], toxic: list[int], filters: str = FILTERS) -> Iterator[tuple]:
    """Rows of one part: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n, whole = len(filters), (1 << len(filters)) - 1
    total = sum(docs)
    corners = [[at_corner(p, s) for s in range(1 << n)] for p in (removal_polynomial(c, n) for c in (docs, good, toxic))]
    gone, good_gone, toxic_gone = corners
    polynomial = removal_polynomial(docs, n)
    shares = [int(shapley_value(polynomial, i) * factorial(n)) for i in range(n)]
    alone = [gone[whole] - gone[whole ^ 1 << i] for i in range(n)]
    for order in permutations(range(n)):
        s = 0
        for step, i in enumerate(order, 1):
            after = s | 1 << i
            removed = gone[after] - gone[s]
            yield (
                "".join(filters[j] for j in order), step, total - gone[after], removed, gone[1 << i] - removed, alone[i],
                good_gone[after] - good_gone[s], toxic_gone[after] - toxic_gone[s], shares[i],
            )
            s = after


_ROW = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _ROW.split(", ")]
    for batch in batches:
        for part, *counts in zip(batch["part"], batch["docs"], batch["good"], batch["toxic"], strict=True):
            out = pd.DataFrame(audit(*([int(x) for x in c] for c in counts)), columns=names)
            out.insert(0, "part", part)
            yield out.astype({"step": "int32"})


def filter_interactions(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """One row a part, order of the filters and step; see :func:`mask_counts` for odd rows.

    Null texts and sources are empty ones.  Repeated rows count one by one;
    equal ids are not smaller than each other, so they are no copies of each
    other.  Without labels nothing good or toxic is lost.  An empty table gives
    no rows.  Other columns are ignored.
    """
    return mask_counts(docs, labels).mapInPandas(_audited, "part string, " + _ROW)


#: The same from counted masks, the orders by brute force.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), f AS (
  SELECT d.part,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
         coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS quality, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
                    FROM labels GROUP BY doc_id) l USING (doc_id)
), m AS (
  SELECT part, fails, count(*) AS n, sum(quality) AS q, sum(toxic) AS t FROM f GROUP BY part, fails
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letter a JOIN letter b ON b.i <> a.i JOIN letter c ON c.i NOT IN (a.i, b.i)
  JOIN letter d ON d.i NOT IN (a.i, b.i, c.i) JOIN letter e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), run AS (
  SELECT part, filter_order, o, n, q, t, fails, s.step,
         fails[o[s.step]] AS failing,
         len(list_filter(o[1:s.step - 1], lambda j: fails[j])) > 0 AS gone,
         len(list_filter(fails, lambda b: b)) = 1 AS once
  FROM m, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), told AS (
  SELECT part, filter_order, o[step] AS i, step,
         sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN once AND failing THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failing THEN q ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND failing THEN t ELSE 0 END) AS toxic_lost
  FROM run GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM told
"""
