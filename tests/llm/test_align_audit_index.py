"""Token alignment, filter audit and digest index against plain code."""

import hashlib
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import digest_index, filter_audit, queries, token_alignment
from flowlens.llm.common import scratch_path

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
ODD_TEXTS = [
    None, "", " ", "  ", "a", "two  spaces\n\n\tand tabs ", "no▁such", "<|endoftext|> </s> <0x41>", "héllo 😀 wörld\u0085x", "ﬁne ﬀ Å", "x" * 3000, "日本語の文章です。" * 50,
    "the same text", "the same text", "\r\nline\r\n", "  sep", " lead", "1234567890 3.14159", "and " * 400,
]

# --- alignment --------------------------------------------------------------


def by_hand(texts):
    """Totals and group strings from the tokenizers called one text at a time, offsets in plain dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte, piece = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    byte.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    docs, count = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a, b = (byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)) if text else ([], [])
        sides = []
        for ids, data in ((a, lambda i: bytes(symbol[c] for c in byte.id_to_token(i))), (b, lambda i: bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode())):
            at, ends, joined = 0, {}, b""
            for k, i in enumerate(ids):
                joined += data(i)
                at += len(data(i))
                ends[at] = k
            sides.append((ids, ends, joined == whole))
        if not whole or not (sides[0][2] and sides[1][2]):
            docs.append(None)
            continue
        common = sorted(set(sides[0][1]) & set(sides[1][1]))
        groups, links, from_a, from_b = [], [], 0, 0
        for end in common:
            to_a, to_b = sides[0][1][end] + 1, sides[1][1][end] + 1
            groups.append(",".join(map(str, a[from_a:to_a])) + "|" + ",".join(map(str, b[from_b:to_b])))
            links.append((a[to_a - 1], b[to_b - 1]))
            from_a, from_b = to_a, to_b
        count.update(links)
        docs.append((len(a), len(b), ";".join(groups), links))
    most = Counter()
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else
        (d[0], d[1], len(d[3]), len(d[3]), sum(count[x] == most[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(d[2].encode()).hexdigest())
        for d in docs
    ]


def aligned(df, **how):
    found = token_alignment.align(df, A, B, **how).collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found), key=str)


@pytest.mark.parametrize("span", [7, token_alignment.SPAN])
def test_alignment_of_odd_texts(spark, span):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").withColumn("pair", F.lit("own")).repartition(3)
    assert aligned(df, span=span) == sorted(((i, *x) for i, x in enumerate(by_hand(ODD_TEXTS))), key=str)


def test_alignment_of_the_table(spark, sf, local):
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, sf).collect()}
    want = by_hand(local["text"].tolist())
    assert len(got) == len(local)
    for doc_id, row in zip(local["doc_id"], want, strict=True):
        r = got[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == row


def test_byte_tokens_are_those_of_the_file(local):
    side, _ = token_alignment._side(A)
    texts = [t for t in local["text"] if t] + [t for t in ODD_TEXTS if t] + [" " * 5000 + "x", "x" * 50_000, "日本語" * 9000]
    for text, ids in zip(texts, side.encode(texts), strict=True):
        assert ids.tolist() == side.model.tokenizer.encode(" " + text, add_special_tokens=False).ids


def test_alignment_by_key_beyond_the_bound(spark, docs, monkeypatch):
    some = docs.where("doc_id < 40")
    want = aligned(some)
    monkeypatch.setattr(token_alignment, "LINK_CLASSES", 5)
    assert aligned(some) == want


def test_alignment_of_odd_tables(spark, odd, none):
    assert len(aligned(odd)) == odd.count()
    assert aligned(none) == []
    long = spark.createDataFrame([(1, "word " * 60_000 + "end"), (None, "word")], "doc_id long, text string")
    assert aligned(long) == sorted(((i, *x) for i, x in zip((1, None), by_hand(["word " * 60_000 + "end", "word"]), strict=True)), key=str)


# --- filter audit -----------------------------------------------------------

counts_of = st.lists(st.integers(0, 9), min_size=8, max_size=8)


@settings(max_examples=40, deadline=None)
@given(counts_of, counts_of, counts_of)
def test_audit_of_three_filters_by_brute_force(docs, good, toxic):
    rows = {(r[0], r[1]): r[2:] for r in filter_audit.audit(docs, good, toxic, "ABC")}
    assert len(rows) == 18
    total = Counter()
    for order in permutations(range(3)):
        name, left = "".join("ABC"[i] for i in order), set(range(8))
        for step, i in enumerate(order, 1):
            fails = {m for m in range(8) if m >> i & 1}
            gone = left & fails
            kept, removed, redundant, unique, g, t, _ = rows[name, step]
            assert removed == sum(docs[m] for m in gone) and redundant == sum(docs[m] for m in fails - left)
            left -= gone
            assert kept == sum(docs[m] for m in left) and unique == docs[1 << i]
            assert (g, t) == (sum(good[m] for m in gone), sum(toxic[m] for m in gone))
            total[i] += removed
    for (name, step), row in rows.items():
        assert row[-1] == total["ABC".index(name[step - 1])]


def test_polynomial_and_shapley():
    p = filter_audit.removal_polynomial([5, 2, 3, 4], 2)  # none, A only, B only, both
    assert p == [0, 6, 7, -4]
    assert [filter_audit.at_corner(p, s) for s in range(4)] == [0, 6, 7, 9]
    assert filter_audit.shapley_value(p, 0) == Fraction(2) + Fraction(4, 2)
    assert factorial(3) == 6


MASKED = [
    ("word " * 200, 2), ("word " * 199, 3), (" ".join(f"w{i}" for i in range(200)), 0), (" ".join(f"w{i}" for i in range(199)), 1), ("", 1), ("A" + "b" * 48, 5), ("A" + "b" * 49, 1), ("# " + " ".join(f"w{i}" for i in range(200)), 8),
    (" ".join([f"w{i}" for i in range(100)] * 2), 0), (" ".join([f"w{i}" for i in range(100)] * 2 + ["w0"]), 2), ("Éa" * 10, 1), ("a|b", 9), ("a b", 1), ("\x1fa\x0b", 1),
]


def test_masks(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in MASKED)), "i int, text string").select("i", filter_audit.row_mask(F.col("text")).alias("m"))
    assert [r.m for r in df.orderBy("i").collect()] == [m for _, m in MASKED]


def audited(df, labels):
    return sorted(tuple(r) for r in filter_audit.filter_interactions(df, labels).collect())


def test_audit_of_odd_tables_matches_sql(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (8, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))
    con = duckdb.connect()
    for name, df in (("documents", odd), ("labels", labels)):
        con.register(name, df.toArrow())
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({filter_audit.SQL})").fetchall())
    assert audited(odd, labels) == want
    assert len(want) == 600 * len({r[0] for r in want})
    assert audited(none, labels) == []
    unmarked = audited(odd, labels.where("false"))
    assert unmarked == audited(odd, None) and all(r[7] == r[8] == 0 for r in unmarked)


# --- digest index -----------------------------------------------------------


def kept(df, **how):
    return sorted((tuple(r) for r in digest_index.dedup_batches(df, scratch_path(df.sparkSession, "index"), **how).collect()), key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_kept_rows(spark, docs, local, batches):
    texts = local["text"].str.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    size, last = Counter(texts), {}
    for doc_id, text in zip(local["doc_id"], texts, strict=True):
        last[text] = max(last.get(text, doc_id), doc_id)
    want = sorted(((d, last[t], size[t], d == last[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in zip(local["doc_id"], texts, strict=True)), key=str)
    assert kept(docs, batches=batches) == want


def test_odd_rows_of_the_index(spark, odd, none):
    rows = kept(odd)
    assert len(rows) == odd.count()
    by_text = Counter(r[4] for r in rows if r[3])
    assert set(by_text.values()) == {1} and set(by_text) == {r[4] for r in rows}
    assert kept(none) == []
    df = spark.createDataFrame([(None, "Same"), (None, "same"), (3, "SAME"), (None, "alone"), (4, "É"), (5, "é"), (6, None), (7, "")], "doc_id long, text string")
    found = Counter((r[0], r[1], r[2], r[3]) for r in kept(df))
    assert found == {(None, 3, 3, False): 2, (3, 3, 3, True): 1, (None, None, 1, True): 1, (4, 4, 1, True): 1, (5, 5, 1, True): 1, (6, 7, 2, False): 1, (7, 7, 2, True): 1}


def test_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr("flowlens.llm.common.HOT_ROWS", 50)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = kept(df)
    assert sum(r[2] == 300 for r in rows) == 300 and sum(r[3] for r in rows) == 601


def test_index_persists_and_repeats_a_batch(spark):
    path = scratch_path(spark, "index")
    rows = lambda *pairs: digest_index.digested(spark.createDataFrame(pairs, "doc_id long, text string"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    index = digest_index.DigestIndex(spark, path, 4)
    assert ids(index.add(rows((1, "a"), (2, "A"), (3, "b")), "first")) == [2, 3]
    assert ids(index.add(rows((9, "a"), (4, "c")), "second")) == [4]
    index.forget()
    again = digest_index.DigestIndex(spark, path, 4)  # a later session
    assert ids(again.table()) == [2, 3, 4]
    second = rows((9, "a"), (4, "c"), (5, "d"))
    assert ids(again.missing(digest_index.classes(second), "second")) == [4, 5]
    plan = again.missing(digest_index.classes(second).drop("n"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    whole = again.compacted(scratch_path(spark, "index"), 8)
    assert ids(whole.table()) == [2, 3, 4] and len(whole.table().inputFiles()) <= 8
    assert ids(whole.add(rows((1, "a"), (8, "z")), "third")) == [8]
