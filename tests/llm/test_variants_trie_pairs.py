"""Spelling variants, conversation trie and byte pairs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bytepairs, prefix_trie, spelling
from tidemark.llm.queries import rebuilt_turns
from tidemark.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- spelling variants


def words_by_hand(rows, least=3):
    lower = {c: c + 32 for c in range(65, 91)}
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= least and len(w) >= 5}


def variants_by_hand(words):
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].append(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def variant_rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_spelling_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = variants_by_hand(words_by_hand(rows))
    assert variant_rows(QUERIES["op11_spelling_variants"](spark, SF)) == want
    assert sum(v[2] is not None for v in want.values()) > 20


@pytest.mark.parametrize("chunk,right", [(8192, 65_536), (5, 7)])
def test_spelling_small_alphabet_and_tiny_chunks(spark, chunk, right):
    draw = random.Random(3)
    words = {"".join(draw.choice("abeïÿ") for _ in range(draw.randint(1, 7))) for _ in range(700)}
    words |= {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "日本", "日本語", "\U0001f600a"}
    words = {w: draw.choice([3, 3, 6, 12, 30]) for w in sorted(words)}
    table = spark.createDataFrame([(w, n, 1) for w, n in words.items()] + [(None, 9, 1)], "word string, n long, form int")
    got = variant_rows(spelling.spelling_variants(table.repartition(5), chunk_words=chunk, right_words=right))
    assert got == variants_by_hand(words)


def test_spelling_edge_rows(spark):
    rows = [(None, "Réseau réseau RÉSEAU"), (1, None), (2, ""), (3, "12 34"), (4, "aaaaa bbbbb" * 3), (4, "aaaaa bbbbb" * 3)]
    rows += [(5, "x" * 5000 + " " + "y" * 70), (6, "Ötztal ötztal"), (7, "ends a"), (8, "bcdef begins")] * 4
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert got == words_by_hand(rows)
    assert spelling.count_words(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(spelling.count_words(docs.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aZzÀÿ× é日\U0001f600", max_size=12), min_size=1, max_size=8), st.integers(1, 9))
def test_letter_runs_in_windows(texts, window):
    raw = [t.encode() for t in texts]
    begins = np.cumsum([0, *map(len, raw)])[:-1]
    got = []
    for runs, owners in spelling.letter_runs(np.frombuffer(b"".join(raw), np.uint8), begins, window):
        got += [(texts[o], w) for o, w in zip(owners.tolist(), runs.to_pylist())]
    lower = {c: c + 32 for c in range(65, 91)}
    assert got == [(t, w) for t in texts for w in re.findall("[a-zÀ-ÿ]+", t.translate(lower))]


# --- conversation trie


def trie_by_hand(convs):
    """``convs``: id -> list of (role, text)."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out = []

    def subtree(key):
        leaves, saved = 0, 0
        stack = [key]
        while stack:
            at = stack.pop()
            leaves += not children[at]
            saved += (len(members[at]) - 1) * len(at[-1][1].encode()) if at else 0
            stack += children[at]
        return leaves, saved

    for key, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(key))
        parent = members[key[:-1]][0] if key else None
        out.append((ids[0], len(key), parent, len(ids), len(children[key]), *subtree(key), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def in_order(rows):
    """``rows``: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    first = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None), key=first):
        turns[conv].append((role or "", text or ""))
    return turns


def rebuilt_by_hand(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_trie_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = trie_by_hand(rebuilt_by_hand(in_order(rows)))
    assert trie_rows(QUERIES["op12_prefix_trie"](spark, SF)) == want


def test_trie_shared_beginnings_nulls_and_repeats(spark):
    draw = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(draw.choice([0, 1, 3, 6, 12])):
            rows.append((c, draw.choice([t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(["é", "b", "", None])))
    rows += [(7, 1, "user", "b")] * 3 + [(None, 0, "user", "lost")] + [(99, t, "user", "a" * t) for t in range(300)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, node int, place int")
    turns = prefix_trie.numbered_turns(table.repartition(7))
    assert trie_rows(prefix_trie.prefix_trie(*rebuilt_turns(turns))) == trie_by_hand(rebuilt_by_hand(in_order(rows)))
    plain = prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct())
    assert trie_rows(plain) == trie_by_hand(in_order(rows))
    none = prefix_trie.numbered_turns(table.limit(0))
    assert prefix_trie.prefix_trie(*rebuilt_turns(none)).count() == 0


def test_list_ranks_by_contraction(spark):
    draw = random.Random(9)
    order = list(range(3000))
    draw.shuffle(order)
    rows = [(a, b, draw.random()) for a, b in zip(order, [*order[1:], None])]
    arcs = spark.createDataFrame(rows, "arc long, next long, near double").repartition(6)
    got = {r.arc: r.dist for r in prefix_trie.list_ranks(arcs, ["near"], rest=16).collect()}
    assert got == {a: len(order) - 1 - k for k, a in enumerate(order)}


def test_ordinals_and_sums_of_a_large_group(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"), ((F.col("id") * 7919) % 20_011).alias("v")
    )
    got = prefix_trie.ordinals(rows, ["g"], ["v"], "t").where("g = -1").orderBy("v").select("ordinal").collect()
    assert [r[0] for r in got] == list(range(1, len(got) + 1))
    places = spark.range(1, 5000).select(F.lit("a").alias("g"), F.col("id").alias("p"), (F.col("id") % 7).alias("s"))
    got = {r.p: r.before_s for r in prefix_trie.sums_before(places, ["g"], "p", ["s"], bits=4).collect()}
    run = 0
    for p in range(1, 5000):
        assert got[p] == run
        run += p % 7


# --- byte pairs


@pytest.fixture(scope="module")
def vocabulary():
    return bytepairs.BytePairs(*bytepairs.read_ranks(RANKS))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(*bytepairs.read_ranks(RANKS))), special_tokens={}
    )


def test_pattern_is_the_given_one():
    assert bytepairs.PATTERN == public_tokenizers.PATTERN


def test_perfect_hash_is_minimal(vocabulary):
    entries, _ = bytepairs.read_ranks(RANKS)
    table = bytepairs.PerfectHash(entries)
    assert sorted(table.entry_at.tolist()) == list(range(len(entries)))
    assert table.find(entries).tolist() == list(range(len(entries)))
    assert set(table.find([b"not an entry", b"", b"\xff\xff\xff"]).tolist()) == {-1}
    for few in (0, 1, 2, 5, 300):
        small = bytepairs.PerfectHash(entries[:few])
        assert small.find(entries[:few]).tolist() == list(range(few)) and (small.find([b"zz zz"]) == -1).all()


_TEXT = st.lists(st.text("aeb stLrvml'd \n\té日9½!.\xa0\x1c \U0001f600", max_size=30), min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(_TEXT, st.sampled_from([3, 20, 1 << 22]))
def test_encode_equals_library(vocabulary, reference, texts, most):
    codes = vocabulary.encode(texts, most)
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == [reference.encode_ordinary(t) for t in texts]
    assert [d.decode() for d in vocabulary.decode(codes)] == texts


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "'s" * 500, " " * 4_000, "x'll 're'VE don't  't", "\U0001f600" * 3_000])
def test_encode_long_runs(vocabulary, reference, text):
    assert np.frombuffer(vocabulary.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_vocabulary_without_monotone_ranks():
    entries = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cab", b"abcab"]
    ids = list(range(256)) + [400, 300, 258, 257, 500]
    own = bytepairs.BytePairs(entries, ids)
    library = tiktoken.Encoding("own", pat_str=bytepairs.PATTERN, mergeable_ranks=dict(zip(entries, ids)), special_tokens={})
    for text in ("abcabcab", "ababab", "cabcab", "bcabcabc ab cabab"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    with pytest.raises(ValueError):
        own.decode([np.array([259], "<u4").tobytes()])
    with pytest.raises(ValueError):
        bytepairs.BytePairs(entries[1:], ids[1:])


def test_byte_pair_query_equals_library(spark, reference):
    got = {r.doc_id: r for r in QUERIES["op13_byte_pairs"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for doc, text in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        hashes = [hashlib.sha256(b).hexdigest() for b in (ids.tobytes(), (text or "").encode())]
        assert [got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256] == [len(ids), *hashes]


def test_byte_pairs_edge_rows(spark):
    rows = [(None, None), (1, ""), (1, "a"), (1, "a"), (2, " ".join(["long"] * 20_000))]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id int, text string, n_tokens int")
    encoded = bytepairs.encode_texts(docs, RANKS)
    assert encoded.columns == ["doc_id", "n_tokens", "token_ids"] and dict(encoded.dtypes)["doc_id"] == "int"
    out = bytepairs.decode_texts(encoded, RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == sorted((d or 0, t or "") for d, t in rows)
    assert [r.n_tokens for r in out if r.doc_id == 2] == [20_000]
    assert bytepairs.encode_texts(docs.limit(0), RANKS).count() == 0
    nulls = spark.createDataFrame([(None,)], "token_ids binary")
    assert bytepairs.decode_texts(nulls, RANKS).first().decoded is None
    with pytest.raises(ValueError):
        bytepairs.decode_texts(encoded, RANKS, out="n_tokens")
