"""SimHash and embedding groups against brute force, and their edge cases."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tidemark.llm import embeddings, simhash
from tidemark.llm.components import connected_components, merge_labels, spanning_forest
from tidemark.llm.gray_index import GrayIndex


def reachable(ids, near):
    comp = list(ids)
    while True:
        new = [min(comp[j] for j in range(len(ids)) if j == i or near[i][j]) for i in range(len(ids))]
        if new == comp:
            return comp
        comp = new


def plain_fingerprint(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("exact", [False, True])
def test_gray_index_finds_every_link(exact):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    codes = []
    for c in centres:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            codes.append(c ^ np.uint64(sum(1 << int(f) for f in flips)))
    codes = np.unique(np.array(codes, np.uint64))

    def rank(x):
        for k in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> np.uint64(k))
        return x

    codes = codes[np.argsort(rank(codes))]
    cut = len(codes) // 3
    starts = np.array([0, cut])  # two groups: no links across
    found = [np.stack(x) for x in GrayIndex(codes, starts).links(4, exact=exact)]
    i, j, d = np.concatenate(found, axis=1)
    truth = {
        (a, b)
        for lo, hi in ((0, cut), (cut, len(codes)))
        for a in range(lo, hi)
        for b in range(a + 1, hi)
        if int(np.bitwise_count(codes[a] ^ codes[b])) <= 4
    }
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert got <= truth
    if exact:
        assert got == truth and len(i) == len(truth)
        assert all(int(np.bitwise_count(codes[a] ^ codes[b])) == w for a, b, w in zip(i, j, d))
    n = np.arange(len(codes))
    a, b = np.array(sorted(truth)).T
    assert (merge_labels(n, i, j) == merge_labels(n, a, b)).all()


def test_spanning_forest_takes_light_links():
    kept = spanning_forest(4, np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3]), np.array([3, 1, 2, 5]))
    assert kept.tolist() == [1, 2, 3]


def test_components_of_chain_hub_and_repeats(spark):
    chain = [(k, k + 1) for k in range(40)]
    hub = [(100, k) for k in range(101, 400)]
    rows = chain + hub + hub[:5] + [(7, 7), (None, 3), (500, 501)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {0} and {got[k] for k in range(101, 400)} == {100}
    assert got[501] == 500 and len(got) == 40 + 299 + 1  # roots are left out
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (2, "the QUICK brown fox\tjumps over the lazy dog again and again"),
    (3, ""),
    (4, None),
    (5, " \n\t "),
    (6, "one two"),
    (7, "ONE  two"),
    (8, "long " * 5000),
    (9, "Ünïcode Ä stays"),
    (9, "Ünïcode Ä stays"),
    (None, "one two"),
]


def test_simhash_groups_equal_brute_force(spark):
    docs = spark.createDataFrame([(t, i, 0) for i, t in TEXTS], "text string, doc_id long, fingerprint int")
    got = simhash.near_duplicate_groups(docs).collect()
    assert len(got) == len(TEXTS)
    named = [(i, t) for i, t in TEXTS if i is not None]
    codes = [plain_fingerprint(t, 4) for _, t in named]
    comp = dict(zip([i for i, _ in named], reachable([i for i, _ in named], [[bin(a ^ b).count("1") <= 4 for b in codes] for a in codes])))
    for r in got:
        assert r.fingerprint & (2**64 - 1) in {plain_fingerprint(t, 4) for i, t in TEXTS if i == r.doc_id}
        assert r.component_id == (comp[r.doc_id] if r.doc_id is not None else None)
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_crowded_patterns_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    codes = {base ^ sum(1 << int(f) for f in rng.choice(14, rng.integers(0, 6), replace=False)) for _ in range(300)}
    rows = [(c, k) for k, c in enumerate(sorted(codes))]
    table = spark.createDataFrame(rows, "fingerprint long, node long")
    links = simhash.fingerprint_links(table, chunk_rows=32).collect()
    by = {k: c for c, k in rows}
    exact = simhash.fingerprint_links(table, chunk_rows=32, exact=True).collect()
    assert all(bin(by[x.a] ^ by[x.b]).count("1") == x.distance <= 4 for x in exact)
    n = np.arange(len(rows))
    got = merge_labels(n, np.array([x.a for x in links]), np.array([x.b for x in links]))
    pairs = [(a, b) for a in n for b in n if a < b and bin(by[int(a)] ^ by[int(b)]).count("1") <= 4]
    want = merge_labels(n, *map(np.array, zip(*pairs)))
    assert (got == want).all()
    assert (merge_labels(n, np.array([x.a for x in exact]), np.array([x.b for x in exact])) == want).all()


def test_similar_groups_and_keep_one(spark):
    words = [f"w{k}" for k in range(200)]
    near = words[:100] + ["changed"] + words[101:]
    far = words[:100] + [f"x{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words)), (5, None), (None, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = simhash.similar_groups(docs)
    assert {r.doc_id: r.component_id for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, None: None}
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs, groups).collect()) == [0, 1, 3, 5]


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(25):
        centre = rng.normal(size=16)
        for _ in range(8):
            rows.append([float(v) for v in centre + rng.normal(size=16) * 0.1])
    rows += [rows[0], rows[0]]
    ids = list(range(len(rows)))
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    table = spark.createDataFrame([*zip(ids, rows), *odd, (None, rows[0])], "vec_id long, embedding array<double>")
    x = np.array(rows)
    cos = x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    near = (cos >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = reachable(ids, near.tolist())
    for settings in ({}, {"rows_per_cell": 20, "probes": 3}, {"block_rows": 16}):
        got = {r.vec_id: r for r in embeddings.link_embeddings(table, **settings).collect()}
        assert len(got) == len(rows) + len(odd) + 1
        found = sum(got[i].n_links for i in ids)
        assert found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in ids)
        if "rows_per_cell" not in settings:
            assert [got[i].n_links for i in ids] == near.sum(axis=1).tolist()
            assert [got[i].component_id for i in ids] == comp
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905))
        assert got[905].n_links == 1 and got[906].component_id == 905 and not got[906].kept
        assert got[None].n_links == 0 and got[None].component_id is None and not got[None].kept
    assert embeddings.link_embeddings(table.limit(0)).count() == 0


def test_similar_pair_that_closes_a_cycle_is_kept(spark):
    # a shared passage makes all texts candidates of each other
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(150)]
    texts = [passage + [f"u{n}_{k}" for k in range(50)] for n in range(1000)]
    for n in range(100):  # near copies: J about 0.9
        copy = list(texts[n])
        for k in rng.choice(np.arange(150, 200), 2, replace=False):
            copy[k] = f"v{n}_{k}"
        texts.append(copy)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(zip(*(t[k:] for k in range(5)))) for t in texts]
    pairs = {(n, 1000 + n) for n in range(100) if len(sets[n] & sets[1000 + n]) >= 0.8 * len(sets[n] | sets[1000 + n])}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert len(pairs) > 70
    assert sum(got[b] == a for a, b in pairs) >= 0.98 * len(pairs)
    assert all(got[k] == k for k in range(1000))


def test_similarity_is_decided_on_full_sets(spark):
    rng = np.random.default_rng(12)
    rows = []
    for n in range(200):
        # 13 spaced changes leave J = 531 / 661 = 0.803 of five-word shingles, 14 leave 526 / 666 = 0.790
        words = [f"{w:x}" for w in rng.integers(0, 2**40, 600)]
        copy = list(words)
        for k in range(13 + n % 2):
            copy[10 + 40 * k] = f"new{n}_{k}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    joined = np.array([got[2 * n + 1] == 2 * n for n in range(200)])
    assert joined[::2].mean() >= 0.97 and not joined[1::2].any()


def test_equal_fingerprints_are_compared(spark):
    many = "of " * 420
    rows = [(k, many + " ".join(f"{side}{n}" for n in range(400))) for k, side in enumerate("ab")]
    assert len({plain_fingerprint(t, 5) for _, t in rows}) == 1
    docs = spark.createDataFrame([*rows, (2, rows[0][1])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == {0: 0, 1: 1, 2: 0}
    # different sets with one fingerprint: compared as candidates at distance 0
    code, sets = np.zeros(3, np.uint64), [np.arange(a, a + 10, dtype=np.uint64) for a in (0, 1, 100)]
    a, b = simhash._Candidates(18, 14, 2, 0.8)._compared(0, code, code, sets)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 1)]


@pytest.mark.parametrize("tile", [1 << 17, 40])
def test_candidates_equal_all_pairs(monkeypatch, tile):
    """Tiles over members in order of size give the pairs that a look at every pair gives."""
    monkeypatch.setattr(simhash, "_TILE", tile)
    rng = np.random.default_rng(11)
    n, starts = 400, np.array([0, 1, 3, 200])
    base = rng.integers(0, 2**64, 8, dtype=np.uint64)
    flip = lambda: sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 14), replace=False))
    code, twin = (np.array([int(base[k % 8]) ^ flip() for k in range(n)], np.uint64) for _ in range(2))
    size, mask = rng.integers(0, 30, n), rng.integers(0, 2, 4)[np.searchsorted(starts, np.arange(n), side="right") - 1] * 5
    found = simhash._Candidates(18, 14, 2, 0.8)
    got = {(min(i, j), max(i, j)) for a, b in found.pairs(mask, code, twin, size, starts) for i, j in zip(a.tolist(), b.tolist())}
    group, want = np.searchsorted(starts, np.arange(n), side="right"), set()
    for i in range(n):
        for j in range(i + 1, n):
            near = bin(int(code[i] ^ code[j])).count("1") <= 18 and bin(int(twin[i] ^ twin[j])).count("1") <= simhash.TWIN_LIMIT
            if group[i] == group[j] and near and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]):
                early = any(found.earlier[k][mask[i]] and not int(code[i] ^ code[j]) & int(p) for k, p in enumerate(found.parts))
                if not early:
                    want.add((i, j))
    assert got == want and len(want) > 100


def test_parities_part_unlike_sets_only():
    """Rows that only chance brought near leave before their sets are read, and no similar pair does."""
    rng = np.random.default_rng(12)
    sets = []
    for k in range(60):
        own = rng.integers(0, 2**64, int(rng.integers(2, 900)), dtype=np.uint64)
        sets.append(np.unique(own))
        # the most that may differ at a similarity of 0.8: a fifth of the larger set is missing
        sets.append(np.unique(own[: -(-4 * len(own) // 5)]))
    size = np.array([len(s) for s in sets], np.int64)
    parity = np.array([simhash._parities(s) for s in sets]).T
    n = len(sets)
    same = np.zeros(n, np.int64)
    table = np.stack([same, same, same, same, np.arange(n), same, size, *parity])
    found = simhash._Candidates(18, 14, 2, 0.8)
    import pyarrow as pa

    def kept(rows):
        part = pa.record_batch([pa.array(c) for c in table[:, rows]], [f"c{k}" for k in range(len(table))])
        return {v for b in found.likely_members()(iter([part])) for v in b.column(4).to_pylist()}

    for k in range(0, n, 2):
        both = len(np.intersect1d(sets[k], sets[k + 1]))
        assert kept([k, k + 1]) == ({k, k + 1} if both / (size[k] + size[k + 1] - both) >= 0.8 else set())
    unlike = [(i, j) for i in range(0, n, 2) for j in range(i + 2, n, 2) if min(size[i], size[j]) >= 0.8 * max(size[i], size[j])]
    assert len(unlike) > 50 and not any(kept([i, j]) for i, j in unlike if size[i] > 20)
