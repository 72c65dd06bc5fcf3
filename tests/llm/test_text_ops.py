import hashlib
import html
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import html_extract, line_dedup, lm, order_minhash, packing, simhash, toxicity
from flowlens.llm.queries import tokenizer_path


# --- SimHash ---------------------------------------------------------------


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("dense", [False, True])
def test_trie_links_span_the_components(dense):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(3 if dense else 150)]
    values = set(seeds)
    for s in seeds:
        for _ in range(200 if dense else 4):
            values.add(s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    v = np.sort(np.array(list(values), dtype=np.uint64))
    want = [(i, j) for i in range(len(v)) for j in range(i) if (int(v[i]) ^ int(v[j])).bit_count() <= 4]
    links = simhash.trie_links(v)
    assert len(links) < len(v) and roots(len(v), links) == roots(len(v), want)


def test_near_duplicates_match_brute_force(docs, local):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = [simhash.fingerprint(t) for t in local.text]
    comp = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    for i, d in enumerate(local.doc_id):
        assert got[d]["fp"] % 2**64 == fp[i] and got[d]["component_id"] == local.doc_id[comp[i]]


@pytest.mark.parametrize("depth,hot", [(2, 4096), (3, 4096), (1, 2)])
def test_every_depth_and_the_hot_path_are_exact(spark, monkeypatch, depth, hot):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)})
    monkeypatch.setattr(simhash, "HOT_SUBTRIE", hot)
    monkeypatch.setattr(simhash, "SUBTRIE", 0 if depth > 1 else 10**9)
    signed = [simhash._signed(v) for v in values]
    links = simhash.hamming_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert roots(len(values), [(at[r["a"]], at[r["b"]]) for r in links]) == roots(len(values), want)


def test_components_of_a_chain(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(59)], "a long, b long")
    assert {r["root"] for r in simhash.components(links).collect()} == {0}


def test_simhash_odd_rows(odd, none):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    zero = {d for d, fp, _ in got if fp == 0}
    assert len(got) == 10 and zero == {3, 5, 6} and {c for d, _, c in got if d in zero} == {3}
    assert {d: c for d, _, c in got}[2] == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "7", "8", "9", "None"]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# --- line runs -------------------------------------------------------------


def brute_lines(docs, least):
    first, gone = {}, set()
    for d, text in docs:
        numbers, _, counts = line_dedup._sequence(text)
        lines = [text.split("\n")[i].strip() for i in numbers]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(counts[s:e]) >= least:
                    run = tuple(lines[s:e])
                    if run in first:
                        gone |= {(d, numbers[i]) for i in range(s, e)}
                    else:
                        first[run] = (d, s)
    return gone


@pytest.mark.parametrize("least", [1, 3, 5, 9])
def test_line_runs_match_brute_force(spark, least):
    rng = random.Random(least)
    lines = ["a", "b c", "d e f", "g h i j k", "", "l m n o p q", " a "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    got = {(r["doc_id"], i) for r in out for s in r["removed_lines"] for i in range(s["first"], s["stop"])}
    assert got == brute_lines(rows, least)
    texts = dict(rows)
    for r in out:
        left = [x for i, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], i) not in got]
        assert r["text"] == ("\n".join(left) if any(x.strip() for x in left) or not r["removed_lines"] else "")


def test_lines_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert set(out.columns) == set(odd.columns)
    got = {str(r["doc_id"]): r["text"] for r in out.collect()}
    assert got["2"] == "" and got["1"].startswith("the same") and got["3"] is None and got["8"] == "x"
    assert out.count() == 10 and line_dedup.dedup_lines(none).count() == 0


# --- packing ---------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


HARD = ["", " ", "a  b", "a\n\nb", "a \nb", "a\n b", " a", "a ", "a\tb c", "don't it's <|endoftext|> x", "x\r\ny z", "日本 語\nか", "a b c", "😀 x\ny", "a\u0085 b", "\x1c a", "a\x1cb c", "1 2,3 4.5 'll  'S"]


def test_chunks_encode_as_the_tokenizer_does(local):
    texts = [*HARD, *local.text]
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.ChunkTokenizer(tokenizer_path()).encode(texts)] == want


def test_packing_round_trip(docs, local):
    got = packing.pack(docs, tokenizer_path(), with_ids=True).toPandas()
    t = tokenizer()
    by = {d: g.sort_values("piece") for d, g in got.groupby("doc_id")}
    for d, text in zip(local.doc_id, local.text):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(by[d].ids) == ids.tobytes()
        assert by[d].start.tolist() == [0, *by[d].length.cumsum()[:-1]] and (by[d].length.iloc[1:] == 2048).all()
        assert [zlib.crc32(x) for x in by[d].ids] == by[d].ids_crc32.tolist()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) * 1.02 + 1


def fewest(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_finds_the_optimum_of_small_cases(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(3, 25, 11).tolist()
    counts = np.bincount(items, minlength=31).astype(np.int64)
    packed = packing.complete_bins(counts, 30)
    used = Counter()
    for own, times in packed.fillings:
        assert sum(own) <= 30
        used.update({x: own.count(x) * times for x in set(own)})
    assert used == Counter(items)
    assert packing.lower_bound(counts, 30) <= packed.bins == fewest(items, 30)


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd, tokenizer_path()).toPandas()
    assert got[got.doc_id == 3].length.tolist() == [1] and got[got.doc_id == 8].length.tolist() == [2, 2]
    assert got[got.doc_id.isna()].shape[0] == 1 and got[got.doc_id == 7].shape[0] > 10
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_packed_sequences_hold_their_ids(spark, sf, local):
    import corpus_pipeline
    from flowlens.llm.queries import op3_bin_completion
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    for got in (op3_bin_completion(spark, sf), corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)):
        got = got.toPandas()
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got.itertuples())
        whole = got.sort_values(["doc_id", "start"]).groupby("doc_id").ids.agg(b"".join)
        for d, t in list(zip(local.doc_id, local.text))[:40]:
            assert whole[d] == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= packing.CAPACITY


# --- language model --------------------------------------------------------


class Brute:
    """The backoff automaton by dictionaries: arcs with probabilities, failure arcs with weights."""

    def __init__(self, trained):
        self.c = [Counter(), Counter(), Counter()]
        for s in trained:
            for n in (1, 2, 3):
                self.c[n - 1].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])

    def p(self, state, w):
        """Follows failure arcs from ``state`` until ``w`` has an arc."""
        if not state:
            return (self.c[0][(w,)] or self.v) / (self.n + self.v)
        lent, c = lm.LENT[len(state)], self.c[len(state) - 1][state]
        fail = lent / (c + lent)
        arc = self.c[len(state)][(*state, w)] / (c + lent)
        return arc + fail * self.p(state[1:], w)

    def score(self, s):
        return sum(math.log10(self.p(tuple(s[max(0, i - 2) : i]), w)) for i, w in enumerate(s))


def test_scores_match_brute_force_over_the_table(docs, local, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 30_000)
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in local.doc_id}
    tokens = {d: [*lm.words(t), b""] for d, t in zip(local.doc_id, local.text)}
    model = Brute([s for d, s in tokens.items() if not held[d]])
    c = model.c[0]
    for d, s in tokens.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(s), sum(c[(w,)] > 0 for w in s), model.n, held[d])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[(w,)] + 1) / (model.n + model.v + 1)) for w in s))
        assert r["score"] == pytest.approx(model.score(s))
    assert sum(r["score"] - r["base_score"] for r in got.values() if r["held_out"]) > 0


def test_automaton_states_sum_to_one():
    rng = np.random.default_rng(5)
    trained = [[*rng.integers(0, 6, rng.integers(1, 30)).tolist(), 6] for _ in range(80)]
    codes = lambda s: np.array(s, np.uint64)
    seen = [dict(zip(*np.unique(keys[real], return_counts=True))) for keys, real in lm.ngram_keys([codes(s) for s in trained], lm.key_mask(10**6))]
    model = Brute(trained)

    def last(s):
        ids, where, keys = zip(*lm.numbered([codes(s)], lm.key_mask(10**6)))
        counts = [np.array([seen[n].get(k, 0) for k in own], np.int64) for n, own in enumerate(keys)]
        return 10 ** lm.automaton(ids, where, counts, model.n, model.v).read(ids[0], np.array([len(s)]))[-1]

    for history in ([], [0], [3], [0, 1], [2, 0], [1, 1], [5, 9], [9, 9]):
        assert sum(last([*history, w]) for w in (*range(7), 99)) == pytest.approx(1.0)
        for w in range(7):
            assert last([*history, w]) == pytest.approx(model.p(tuple(history), w))


def _automaton_of(trained, texts):
    """The automaton that the texts can reach, its input and the names of its states."""
    codes = lambda s: np.array(s, np.uint64)
    mask = lm.key_mask(10**6)
    seen = [dict(zip(*np.unique(keys[real], return_counts=True))) for keys, real in lm.ngram_keys([codes(s) for s in trained], mask)]
    ids, where, keys = zip(*lm.numbered([codes(s) for s in texts], mask))
    counts = [np.array([seen[n].get(k, 0) for k in own], np.int64) for n, own in enumerate(keys)]
    flat = [w for s in texts for w in s]
    names = [()]
    for n in range(lm.ORDER - 1):
        names += [tuple(flat[e - n : e + 1]) for e, c in zip(where[n], counts[n]) if c]
    model = Brute(trained)
    return lm.automaton(ids, where, counts, model.n, model.v), ids[0], [flat[e] for e in where[0]], names, model


def test_automaton_states_arcs_and_failure_arcs():
    rng = np.random.default_rng(11)
    made = lambda k: [[*rng.integers(0, 9, rng.integers(1, 40)).tolist(), 9] for _ in range(k)]
    trained, texts = made(40), [*made(15), [77, 1, 77, 2, 9]]
    a, _, words, names, model = _automaton_of(trained, texts)
    assert len(a.fail) == len(a.fail_log) == len(names) and len(set(names)) == len(names)
    here = [{g for s in texts for g in zip(*(s[i:] for i in range(n)))} for n in (1, 2, 3)]
    assert set(names[1:]) == {g for n in (0, 1) for g in here[n] if model.c[n][g]}
    for state, name in enumerate(names[1:], 1):
        lent, c = lm.LENT[len(name)], model.c[len(name) - 1][name]
        assert names[a.fail[state]] == name[1:] and 10 ** a.fail_log[state] == pytest.approx(lent / (c + lent))
    arcs = {(names[k // len(words)], words[k % len(words)]): j for j, k in enumerate(a.arcs[:-1].tolist())}
    assert set(arcs) == {(g[:-1], g[-1]) for n in (1, 2) for g in here[n] if model.c[n][g]}
    for (name, w), j in arcs.items():
        longest = next(t for i in range(3) if len(t := (*name, w)[i:]) < lm.ORDER and t in names)
        assert names[a.arc_to[j]] == longest and 10 ** a.arc_log[j] == pytest.approx(model.p(name, w))
    for k, w in enumerate(words):
        assert names[a.root_to[k]] == ((w,) if model.c[0][(w,)] else ()) and 10 ** a.root_log[k] == pytest.approx(model.p((), w))


def test_one_traversal_carries_the_state_and_pieces_start_in_the_right_one(monkeypatch):
    rng = np.random.default_rng(12)
    made = lambda k, most: [[*rng.integers(0, 12, rng.integers(1, most)).tolist(), 12] for _ in range(k)]
    trained, texts = made(60, 50), [*made(20, 30), *made(2, 400), [12]]
    a, read, _, _, model = _automaton_of(trained, texts)
    state, one_by_one = np.zeros(1, np.int64), []
    for s in texts:
        state[:] = 0
        for k in read[len(one_by_one) : len(one_by_one) + len(s)]:
            log, state = a.step(state, np.array([k]))
            one_by_one.append(log[0])
    lengths = np.array([len(s) for s in texts])
    for piece in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(lm, "PIECE", piece)
        assert a.read(read, lengths) == pytest.approx(one_by_one)
    assert np.add.reduceat(a.read(read, lengths), np.cumsum(lengths) - lengths) == pytest.approx([model.score(s) for s in texts])


def test_copies_of_held_out_texts_score_higher(spark):
    """Text that training holds is told from text that it doesn't, though all words are known to it."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    made = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(d, made()) for d in range(300)]
    out = [d for d in range(300, 2000) if zlib.crc32(str(d).encode()) % 7 == 2][:40]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    rows += [(d, kept[i][1] if i % 2 else made()) for i, d in enumerate(out)]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[d] for d in out[1::2]) > max(got[d] for d in out[::2]) + 20


def test_lm_odd_rows(odd, none):
    got = lm.score_documents(odd).collect()
    assert len(got) == 10 and {r["n_tokens"] for r in got if r["doc_id"] in (3, 5, 6)} == {1}
    assert all(math.isfinite(r["score"]) and r["n_known"] <= r["n_tokens"] for r in got)
    assert lm.score_documents(none).count() == 0


# --- toxicity --------------------------------------------------------------


def test_toxicity_is_learned(spark):
    from flowlens.llm import toxicity as T

    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        ws = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(60), rng.choice(["zquax", "wobblefuzz", "grumpf" + rng.choice(["ling", "aber", "osto", "unt"])]))
        rows.append((i, " ".join(ws) + ".", "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    grammar = T.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in T.score_documents(docs, grammar).collect()}
    wrong = [i for i, r in got.items() if r["predicted"] != int(i % 6 == 0)]
    assert len(wrong) <= 6 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sorted(r["doc_id"] for r in T.accepted(docs, grammar).collect()) == sorted(i for i, r in got.items() if not r["predicted"])


def test_grammar_labels():
    g = toxicity.Grammar(frozenset({"blark"}), frozenset({"snurf"}), dict(toxicity.PRIOR), toxicity.BASE)
    cases = {
        "you blark": {"I+": 1}, "a blark day": {"I": 1}, "not a blark": {"I-": 1}, "he said blark": {"Ir": 1}, "he said you are not a blark": {"I-r+": 1},
        "you are a snurfling, I will kill you": {"I+": 1, "T+": 1}, "not now, blark": {"I": 1}, "unblark snurf": {}, "BLARK! you. blark": {"I": 2},
    }
    for text, want in cases.items():
        assert dict(g.labels(text)) == want, text
    assert g.score("you blark, you blark") > 0.5 > g.score("he said you are not a blark") > g.score("nothing here")


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(odd, labels)
    got = toxicity.score_documents(odd, grammar).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.accepted(odd, grammar).columns == odd.columns
    assert toxicity.score_documents(none, toxicity.learn(none, labels.where("false"))).count() == 0


# --- order MinHash ---------------------------------------------------------


def test_fingerprints_of_documents_and_edits(docs, local):
    got = {r["doc_id"]: r for r in order_minhash.fingerprint_chain(docs).collect()}
    down = local.iloc[::-1].reset_index(drop=True)
    near = []
    for i in range(len(down)):
        text, after = down.text[i], down.text[(i + 1) % len(down)]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[down.doc_id[i]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == order_minhash._hex(order_minhash.sketch(text)) and r["edited_fingerprint"] == order_minhash._hex(order_minhash.sketch(changed))
        near.append(r["near_edited"] > r["near_next"])
    assert np.mean(near) > 0.9


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    whole = " ".join(words)
    own = order_minhash.sketch(whole)
    seen = []
    for share in (0.0, 0.05, 0.2, 0.6):
        changed = [("".join(rng.choice("klmnop") for _ in range(6)) if rng.random() < share else w) for w in words]
        seen.append(order_minhash.likeness(own, order_minhash.sketch(" ".join(changed))))
    assert seen[0] == 1.0 and seen == sorted(seen, reverse=True) and seen[-1] < 0.3
    swapped = " ".join(words[200:] + words[:200])
    assert order_minhash.likeness(own, order_minhash.sketch(swapped)) < 0.8  # same k-mers, other order


def test_order_minhash_odd_rows(odd, none):
    got = order_minhash.fingerprint_chain(odd).collect()
    assert len(got) == 10
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and len({r["fingerprint"] for r in got if r["n_chars"] == 0}) == 1
    assert order_minhash.fingerprint_chain(none).count() == 0
    alone = order_minhash.fingerprint_chain(odd.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


# --- HTML ------------------------------------------------------------------

SITE = '<html><head><title>T {0}</title></head><body><header>Site</header><nav><ul>{1}</ul></nav><div class="cookie-notice">We use cookies</div><main><h1>Head {0}</h1>{2}</main><aside>Side</aside><section id="comments"><p>Reader says</p></section><form><p>Mail</p></form><footer>&copy; all</footer></body></html>'


def test_wrapper_of_a_host_and_its_pages():
    pages = [SITE.format(i, "<li><a>m</a></li>" * (2 + i), "<p>One &amp; <b>two</b>\n three</p>" * (i + 1) + ("<h2>More</h2><p>x</p>" if i % 2 else "")) for i in range(4)]
    wrapper = html_extract.infer(pages)
    kinds = str(wrapper["items"])
    assert "'*'" in kinds and "'?'" in kinds
    for i, p in enumerate(pages):
        assert html_extract.match(wrapper["items"], html_extract.tree(p), frozenset()) is not None
        want = "\n".join([f"Head {i}"] + ["One & two three"] * (i + 1) + (["More", "x"] if i % 2 else []))
        assert html_extract.main_text(p, wrapper) == want == html_extract.main_text(p)


#: Pages of a made-up site without article elements, and their texts, written by hand.
SOUP = """<html><body><header><h2>Daily Site</h2></header><div class="top"><a href=/>Home</a> | <a href=/n>News</a></div>
<div class="notice">We use cookies to remember what you read.</div>
<div class="wrap"><div class="text"><h1>{title}</h1><div class="notice">{note}</div>{body}<div class="share">Tell your friends about this story</div></div>
<div class="side"><b>Weather</b><p>{side}</p><ul><li><a href=1>{link}</a></li><li><a href=2>Other</a></li></ul></div></div>
<div class="foot">Made by the people of the Daily Site.</div></body></html>"""


def soup(i):
    word = ["heron", "kettle", "ladder", "mirror", "napkin", "orchard", "pencil", "quarry"][i % 8]
    body = "".join(f"<p>The {word} number {i} was seen by {j} people who wrote it down.</p>" for j in range(2 + i % 3))
    body += f"<table><tr><td>{word}<td>{i} of them</table>" * (i % 2)
    page = SOUP.format(title=f"A {word} &amp; more", note=f"Corrected on day {i}", body=body, side=f"{i} degrees", link=f"Read on about {word}s")
    text = [f"A {word} & more", f"Corrected on day {i}", *(f"The {word} number {i} was seen by {j} people who wrote it down." for j in range(2 + i % 3))]
    return page, "\n".join(text + [word, f"{i} of them"] * (i % 2))


def test_template_texts_and_the_heaviest_element_decide(spark):
    """Constants of the site go, inside the article too; what varies there stays, whatever its class."""
    rows = [(i, f"http://soup.example/{i}", soup(i)[0]) for i in range(30)]
    rows += [(100 + i, f"https://one.example/{i}", SITE.format(i, "<li><a>m</a></li>", f"<div class='share price'>Up {i}</div><div id=dialog>Talk {i}</div><div class=comments><p>me too</p></div>")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == soup(i)[1]
    for i in range(5):
        assert got[100 + i] == f"Head {i}\nUp {i}\nTalk {i}"


def test_copies_of_one_page_are_no_template(spark):
    """A host whose pages are mostly one article, and one of three pages, keep their texts."""
    rows = [(i, "http://copies.example/x", soup(1)[0]) for i in range(20)] + [(20 + i, "http://copies.example/y", soup(i)[0]) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(soup(1)[1].split("\n")[0] in got[i] for i in range(20))


def test_pages_that_do_not_fit_are_sampled_again_or_cut_at_the_same_element():
    pages = [soup(i)[0] for i in range(6)]
    constants = frozenset.intersection(*(frozenset(r.hash for r in html_extract.runs(html_extract.tree(p))) for p in pages))
    wrapper = html_extract.infer(pages, constants)
    page, text = soup(7)
    other = page.replace("<table>", "<section><h3>Also</h3><blockquote>Said so</blockquote></section><table>")
    assert html_extract.match(wrapper["items"], html_extract.tree(other), constants) is None
    lines = text.split("\n")
    want = "\n".join([*lines[:-2], "Also", "Said so", *lines[-2:]])
    assert html_extract.main_text(other, wrapper) == want
    wider = html_extract.infer([*pages, other], constants)
    assert html_extract.match(wider["items"], html_extract.tree(other), constants) is not None and html_extract.main_text(other, wider) == want


def test_long_and_deep_pages_are_read_whole():
    page = "<article>" + "<div>" * 3000 + "".join(f"<h2>t{i}</h2><p>b{i}" + "<ul><li>x</ul>" * (i % 3 == 0) for i in range(4000)) + "</article>"
    lines = [x for i in range(4000) for x in (f"t{i}", f"b{i}", *(["x"] if i % 3 == 0 else []))]
    assert html_extract.main_text(page) == "\n".join(lines)
    assert html_extract.main_text(page, html_extract.infer([page, "<article><p>y</article>"])) == "\n".join(lines)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<article>a<br>b &lt;c&gt; &am <p>d", "a\nb <c> &am\nd"), ("<article><script>var a='</p>';</script>x<!-- y -->z</article>", "xz"),
    ("<article>1 < 2<p>cut <a hr", "1 < 2\ncut"), ("<article><p class='ad'>buy</p><P>Keep</P></article><p>out</p>", "Keep"), ("<nav>only</nav>", ""),
])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("frame", ["<div>{}</div>", "<section>{}</section>", "<blockquote>{}</blockquote>", "<p>{}</p>"])
def test_article_text_that_pages_share_stays(spark, frame):
    """Also at the article's edge; shared links, a newsletter and reader comments in the article go."""
    shared = frame.format("All pages share this passage of the article, word for word.")
    own = lambda i: f"<p>Page {i} has a longer text of its own, which no other page has, about the number {i * 7919}.</p>"
    end = '<div class="links"><a href=1>Read this next</a></div><div class="newsletter"><p>Sign up now</p></div><div class="share">Tell a friend</div>'
    readers = "".join(f'<li class="{{}}"><b class="user-name">Reader {j}</b><p>me too {j}</p></li>' for j in range(3))
    rows, want = [], {}
    for i in range(6):
        comments = f'<ul class="comment-list-items">{readers.format(*["reader-comment"] * 3)}</ul>' if i % 2 else f'<ul class="replies">{readers.format(*["x1", "x2", "x3"])}</ul>'
        rows.append((i, "http://shared.example/a", f"<body><article><h1>T{i}</h1>{shared}{own(i)}{end}{comments}</article><div>Site</div></body>"))
        rows.append((10 + i, "http://last.example/a", f"<body><article><h1>T{i}</h1>{own(i)}{shared}</article><div>Site</div></body>"))
        text = [f"T{i}", "All pages share this passage of the article, word for word.", f"Page {i} has a longer text of its own, which no other page has, about the number {i * 7919}."]
        want[i], want[10 + i] = "\n".join(text), "\n".join([text[0], text[2], text[1]])
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_lists_and_bylines_are_no_comments():
    page = '<article class="post comments-open"><div class="author">Ann</div><ul><li>One<p>more</li><li>Two<p>more</li></ul><section><h2>Part</h2><p>x</section><section><h2>Part</h2><p>y</section></article>'
    assert html_extract.main_text(page) == "Ann\nOne\nmore\nTwo\nmore\nPart\nx\nPart\ny"


def test_the_same_text_elsewhere_is_no_template(spark):
    """A headline that other pages of the host show beside their articles stays in its own."""
    page = lambda i, head, aside: f"<body><div class=ad>{aside}</div><article><h1>{head}</h1><p>Text {i} of its own, long enough to be an article.</p></article></body>"
    rows = [(i, "http://heads.example/a", page(i, "Common head" if i else "Other", "x" if i else "Common head")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{'Common head' if i else 'Other'}\nText {i} of its own, long enough to be an article." for i in range(4)}


def test_every_page_of_a_host_weighs_its_elements(spark):
    """Which element holds the article is decided by all pages: of those of one layout most have more beside it than in it."""
    story = lambda i: f"A few words of page {i} here." if i % 8 else " ".join([f"Of page {i} there is a great deal to be told."] * 60)
    page = lambda i: f'<body><div class="story"><p>{story(i)}</p></div><div class="beside"><p>Beside page {i} lies a longer note about other things.</p></div></body>'
    rows = [(i, "http://weigh.example/a", page(i)) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: story(i) for i in range(40)}


def test_every_layout_of_a_host_is_in_its_wrapper(spark):
    """Layouts are aligned in groups, and the result fits each of them, however many there are."""
    tags = ["table", "ul", "section", "blockquote", "pre", "dl", "figure", "address"]
    page = lambda i: "<body><article>" + "".join(f"<{t}>{t} {i}</{t}>" for k, t in enumerate(tags) if i >> k & 1) + f"<h1>T{i}</h1></article></body>"
    rows = spark.createDataFrame([("many.example", page(i)) for i in range(256)], "__host string, html string")
    templates = html_extract.template_texts(rows)
    wrappers = [json.loads(r["__wrapper"]) for r in html_extract.infer_hosts(rows, templates).collect()]
    assert len(wrappers) == 1
    for i in range(256):
        text, fits = html_extract.extracted(page(i), wrappers[0])
        assert fits and text.endswith(f"T{i}") and len(text.split("\n")) == 1 + i.bit_count()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_extract_table(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub("<b>|</b>", "", x)).split()) for x in re.split("</?(?:h1|p|br)>", article))
        assert got[r["page_id"]]["text"] == "\n".join(x for x in blocks if x) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    odd = spark.createDataFrame([(1, None, None), (None, "http://a/x", "<p>t</p>"), (2, "no url", ""), (2, "no url", "")], "page_id long, url string, html string").withColumn("text", F.lit("own"))
    assert sorted(r["text"] for r in html_extract.extract(odd).collect()) == ["", "", "", "t"]
    assert html_extract.extract(odd.where("false")).count() == 0


def test_order_minhash_by_brute_force():
    """K-mers numbered by a dictionary, the two least of each permutation by sorting, pairs in text order."""
    rng = random.Random(8)
    k, u = order_minhash.KMER, np.uint64
    texts = ["", "abc", "a" * 60, "abcabcabc" * 9, "héé😀" * 12] + ["".join(rng.choice("ab ") for _ in range(rng.randint(9, 400))) for _ in range(12)]
    for text in texts:
        padded = [text] if len(text) < k else [text[i : i + k] for i in range(len(text) - k + 1)]
        seen, hashes = Counter(), []
        for kmer in padded:
            h = order_minhash.numbered_kmers(kmer)[0]
            if seen[kmer]:
                h = order_minhash._mix(np.array([h + u(seen[kmer]) * order_minhash._ROLL]))[0]
            seen[kmer] += 1
            hashes.append(int(h))
        want = []
        for a in order_minhash._SLOT_A.tolist():
            ranked = sorted(range(len(hashes)), key=lambda i: ((hashes[i] >> 32) * a % 2**32, i))
            low, high = sorted((ranked[:2] * 2)[:2])
            pair = (hashes[low] * int(order_minhash._ROLL) + hashes[high]) % 2**64
            want.append(int(order_minhash._mix(np.array([pair], u))[0]) >> 48)
        assert order_minhash.sketch(text).tolist() == want


def test_order_minhash_ties_and_repeats(spark):
    """Rows of one id, some equal, over more ranges than rows: every row once, each followed by the next in order."""
    rows = [(1, f"text {i % 7} of one id " * 3) for i in range(40)] + [(None, "no id"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = order_minhash.fingerprint_chain(df).toPandas()
    assert len(got) == 42
    key = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    chain = sorted(key, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.t))
    want = Counter()
    for a, b in zip(chain, chain[1:] + chain[:1]):
        want[a.doc_id, hashlib.sha256(order_minhash.edited(a.t, b.t).encode()).hexdigest()] += 1
    assert Counter((None if d != d else int(d), s) for d, s in zip(got.doc_id, got.edited_sha256)) == want


def test_bin_completion_of_many_pieces_a_sequence():
    """Sequences of 5 to 20 pieces, made by cutting full ones: never worse than best fit, and better where that fails."""
    better = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        bins, capacity = 12, 100
        items = []
        for _ in range(bins):
            cuts = np.sort(rng.choice(np.arange(1, capacity), rng.integers(4, 9 if seed % 2 else 19), replace=False))
            items += np.diff([0, *cuts, capacity]).tolist()
        counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        first, packed = packing._best_fit(counts, capacity).bins, packing.complete_bins(counts, capacity)
        assert bins <= packed.bins <= first and Counter(x for own, t in packed.fillings for x in own * t) == Counter(items)
        better += packed.bins < first
    assert better or first == bins
    counts = np.zeros(31, np.int64)
    counts[[7, 6, 5, 4]] = 2, 2, 2, 6  # 7+7+4+4+4+4 and 6+6+5+5+4+4
    assert len(packing.fillings(counts, 30)[0]) == 6 or sum(packing.fillings(counts, 30)[0]) == 30


def test_composed_transducers_by_brute_force():
    """Each label by reading the clause anew: what stands before it, and whether the clause names a target."""
    rng = random.Random(6)
    for _ in range(3000):
        clause = [rng.choice("IITYNRO,O") for _ in range(rng.randint(1, 9))]
        state, got = (0, 0, int("Y" in clause)), []
        for s in clause:
            state, out = toxicity.MACHINE[state, s]
            got.append(out)
        for i, s in enumerate(clause):
            if s not in "IT":
                continue
            before = clause[max(0, i - 3) : i]
            near = "".join(before).rpartition(",")[2]
            want = s + "-" * ("N" in near) + "r" * ("R" in clause[:i]) + "+" * ("Y" in clause)
            assert got[i] == want, clause


def test_labels_learn_the_same_whatever_text_of_a_repeated_id_comes_first(spark):
    rows = [(i, ("you are a vile frump " if i % 2 else "a fine day ") + str(i * 31 % 17)) for i in range(60)]
    rows += [(i, f"other text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.learn(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 2), (rows[::-1], 5)))
    assert (a.insults, a.stems, a.weights, a.base) == (b.insults, b.stems, b.weights, b.base)
