"""Top-k, nearest neighbours, packing, SimHash, substring dedup, the pipeline."""

import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from fixtures import awkward, frame, prose

from graphloom.llm import ann, buckets, graph, packing, simhash, substring, topk

VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def vector_rows(n=700, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    m = (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(i, rows[5][1]) for i in range(2000, 2040)]  # ties
    rows += [(3000, None), (3100, [1.0, None] * (dim // 2)), (3200, [float("nan")] * dim), (3300, [float("inf")] * dim), (3400, []), (None, rows[0][1]), (3500, [1.0, 2.0]), (3501, [2.0, 1.0])]
    rows += [(100, rows[100][1]), (600, [0.0] * dim)]
    return rows


def usable(rows, zero):
    return [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))]


def brute(rows, zero, score):
    """Sorted (query, rank, id, score) lists; key ascending."""
    ok = usable(rows, zero)
    out = []
    for q, v in ok:
        if q % 100 == 0:
            found = sorted((score(v, w), i) for i, w in ok if i != q and len(w) == len(v))[:10]
            out += [(q, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_exact_topk(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id, -r.score) for r in topk.search(df).collect())
    assert got == brute(rows, True, lambda a, b: -int(np.floor(a * 1024) @ np.floor(b * 1024)))
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.filter("vec_id = 3500")).count() == 0


def test_exact_topk_of_huge_components(spark):
    big = [(0, [3e12, -2e12]), (1, [1e12, 1e12]), (2, [2e12, 1e12]), (3, [1.5, 2.5])]
    got = topk.search(spark.createDataFrame([(*r, 0, "x") for r in big], VECTORS)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]  # two are beyond 64 bits and tie
    assert got[0].score == got[1].score == 2**63 - 1


def test_nearest_neighbours(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)
    found = ann.search(df).collect()
    true = brute(rows, False, lambda a, b: float(np.sqrt(((b - a) ** 2).sum())))
    want, got = Counter((q, i) for q, _, i, _ in true), Counter((r.query_id, r.vec_id) for r in found)
    assert sum((want & got).values()) >= 0.9 * sum(want.values())
    vec = dict(usable(rows, False))
    for r in found:
        assert r.score == np.sqrt(((vec[r.vec_id] - vec[r.query_id]) ** 2).sum())
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append((r["rank"], r.score, r.vec_id))
    for q, x in by.items():
        if q not in (100, 600):  # ids that two rows bear
            assert [r for r, *_ in sorted(x)] == list(range(1, len(x) + 1)) and sorted(x) == sorted(x, key=lambda t: t[1:])
    assert ann.search(df.limit(0)).count() == 0


def test_blocks_of_queries_find_what_one_block_does(spark, monkeypatch):
    from graphloom.llm import vectors

    rows = vector_rows(n=900)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)
    one = sorted(map(tuple, topk.search(df).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 4)
    assert sorted(map(tuple, topk.search(df).collect())) == one
    found = Counter((r.query_id, r.vec_id) for r in ann.search(df).collect())
    true = Counter((q, i) for q, _, i, _ in brute(rows, False, lambda a, b: float(np.sqrt(((b - a) ** 2).sum()))))
    assert sum((true & found).values()) >= 0.9 * sum(true.values())


def test_ties_at_the_last_place_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [2.0, 0.0]) for i in range(30, 0, -1)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)
    assert [r.vec_id for r in ann.search(df).orderBy("rank").collect()] == list(range(1, 11))


def test_tree_puts_every_vector_in_a_leaf_it_can_visit():
    m = np.random.default_rng(1).normal(size=(500, 6))
    tree = ann.Tree(m, 10)
    assert sorted(tree.visits(m[0], tree.leaves)) == list(range(tree.leaves))
    assert set(tree.leaf(m)) <= set(range(tree.leaves))
    assert np.mean([tree.visits(v, 1)[0] == leaf for v, leaf in zip(m, tree.leaf(m))]) > 0.95


# --- packing


def plain_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and not (s >= 0 and s in b["s"]) and not (c >= 0 and c in b["c"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out


def test_best_fit_equals_a_plain_search():
    rng = random.Random(0)
    for _ in range(40):
        n = rng.randrange(1, 120)
        lengths = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randrange(-1, 5) for _ in range(n)], [rng.randrange(-1, 40) for _ in range(n)]
        assert packing.best_fit(lengths, sources, clusters, 100) == plain_best_fit(lengths, sources, clusters, 100)


def test_packing_keeps_every_word_and_every_rule(spark):
    rows = awkward()
    packed = packing.pack(packing.items(frame(spark, rows)), capacity=100, shard_bins=50).collect()
    words = Counter()
    for i, t, *_ in rows:
        words[i] += len((t or "").encode().split())
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert +got == +words and {r.doc_id for r in packed} == {r[0] for r in rows}
    source = {i: (s[1] if len(s) > 1 else None) for i, _, *s in rows}
    text = {i: t for i, t, *_ in rows}
    bins = defaultdict(list)
    for r in packed:
        if r.bin_id is None:
            assert words[r.doc_id] == 0
        else:
            bins[r.bin_id].append(r)
    for own in bins.values():
        assert sum(r.length for r in own) + own[0].free == 100 and own[0].free >= 0
        named = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert len(set(named)) == len(named)
        assert len({" ".join(text[r.doc_id].lower().split()) for r in own}) == len(own)
    assert packing.pack(packing.items(frame(spark, []))).count() == 0


def test_packing_does_not_depend_on_how_files_are_split(spark):
    rows = packing.items(frame(spark, awkward() + awkward()[:9] * 3))
    found = [sorted((r.bin_id or -1, r.slot, r.doc_id or -1, r.piece, r.length) for r in packing.pack(rows.repartition(n), capacity=100, shard_bins=10, shard_pieces=40).collect()) for n in (1, 5)]
    assert found[0] == found[1]


def test_a_dominant_source_is_skipped_in_runs():
    rng = random.Random(4)
    n = 1500
    lengths = sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True)
    sources = [0 if rng.random() < 0.7 else rng.randrange(1, 30) for _ in range(n)]
    bins = packing.best_fit(lengths, sources, [-1] * n, 100)
    assert bins == plain_best_fit(lengths, sources, [-1] * n, 100)


# --- SimHash


def brute_print(text, size=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, most=4):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def close_texts(seed, n):
    """A base and edits of it, at all distances."""
    rng = random.Random(seed)
    base = prose(rng, 150).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_simhash_components(spark):
    rows = awkward() + [(3000 + i, t) for i, t in enumerate(close_texts(1, 120))] + [(4000 + i, t) for i, t in enumerate(close_texts(2, 40))] + [(5000 + i, f"w{i % 7}") for i in range(30)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {i: brute_print(t) for i, t, *_ in rows if i is not None}
    want = brute_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
            assert r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    alone = simhash.near_duplicates(frame(spark, [(None, "a b c d e"), (None, None)])).collect()
    assert [r.component_id for r in alone] == [None, None]


def test_ring_keys_meet_every_pair_in_reach():
    rng = np.random.default_rng(0)
    ring = simhash.Ring(4, 5)
    for _ in range(400):
        a = rng.integers(0, 2**64, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        x, y = ring.keys(np.array([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("bucket", [40, None])
def test_ring_components_whatever_the_size_of_a_bucket(spark, bucket):
    rng = random.Random(9)
    prints = {rng.choice([0, (1 << 64) - 1, 0x00FF00FF00FF00FF]) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 8))) for _ in range(160)}
    nodes = spark.createDataFrame([(signed(f), signed(f)) for f in prints], "node long, f0 long")
    linked = {r.node: r.component for r in simhash.ring_components(nodes, simhash.Ring(4, 5), bucket).collect()}
    want = brute_components({signed(f): f for f in prints})
    least = {}
    for i, c in want.items():
        least[c] = min(least.get(c, i), i)
    assert {i: linked.get(i, i) for i in want} == {i: least[c] for i, c in want.items()}


def test_rows_of_joins_grow_with_a_hot_group_of_near_copies_and_no_faster(spark, monkeypatch):
    made = []

    def counting(df, keep=simhash.table):
        out = keep(df)
        made.append(out.count())
        return out

    for module in (simhash, buckets, graph):
        monkeypatch.setattr(module, "table", counting)
    total = []
    for n in (500, 2000):
        rng = random.Random(n)
        base = rng.getrandbits(64)
        prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(n)} | {rng.getrandbits(64) for _ in range(500)}
        made.clear()
        simhash.ring_components(spark.createDataFrame([(signed(f), signed(f)) for f in prints], "node long, f0 long"), simhash.Ring(4, 5))
        total.append(sum(made) / n)
    assert max(total) < 80  # a node has 64 keys


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def test_near_duplicate_stage_keeps_one_of_a_group_and_all_clean_ones(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 200)) for i in range(80)]
    copies = []
    for i in range(40):
        w = rows[i][1].split()
        for _ in range(i % 3):
            w[rng.randrange(200)] = f"new{i}"
        copies.append((500 + i, " ".join(w)))
    assert all(len(shingles(a[1]) & shingles(b[1])) >= 0.8 * len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows, copies))
    extra = [(900, None), (901, ""), (902, None), (None, "text"), (None, "text")]
    df = frame(spark, rows + copies + extra)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [*range(80), 900] and ids.count(None) == 2
    half = [(1, " ".join(f"a{k}" for k in range(100))), (2, " ".join([f"a{k}" for k in range(60)] + [f"b{k}" for k in range(40)]))]
    assert simhash.deduplicated(frame(spark, half)).count() == 2


def test_near_duplicate_stage_keeps_texts_whose_filler_is_their_print(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100)) + " ---" * 120) for i in range(20)]
    assert sorted(r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect()) == list(range(20))


def test_near_duplicate_stage_joins_equal_sets_whose_repeats_differ(spark):
    words = " ".join(f"w{k}" for k in range(150))
    rows = [(i, words + " and" * n) for i, n in enumerate((6, 60, 200))] + [(3, words + " and" * 60 + " or")]
    assert [r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect()] == [0]


def test_near_duplicate_stage_joins_sets_of_equal_prefixes(spark):
    rows = [(i, prose(random.Random(i // 3), 90) + " more" * (i % 3)) for i in range(120)]
    assert sorted(r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect()) == list(range(0, 120, 3))


def test_near_duplicate_stage_joins_every_pair_at_the_bound(spark):
    rows = []
    for i in range(150):
        w = [f"p{i}x{k}" for k in range(8)]
        rows += [(4 * i, " ".join(w)), (4 * i + 1, " ".join([*w, f"q{i}"]))]  # 4 of 5 shingles shared
        w = [f"r{i}x{k}" for k in range(104)]
        rows += [(4 * i + 2, " ".join(w)), (4 * i + 3, " ".join([*w, *(f"s{i}x{k}" for k in range(25))]))]  # 100 of 125
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert found == {i: i - i % 2 for i in range(600)}


def test_bounds_of_sets_never_lose_a_pair(spark):
    rng = np.random.default_rng(4)
    sets = simhash.Sets(2, 0.8)
    frequent = np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64))
    times = rng.integers(3, 9, 300)
    held = []
    for _ in range(200):
        n = int(rng.integers(4, 300))
        a = np.unique(np.concatenate((rng.choice(frequent, n // 2, replace=False), rng.integers(0, 2**64, n - n // 2, dtype=np.uint64))))
        few = int(0.2 * len(a))
        held.append((a, np.delete(a, rng.choice(len(a), few, replace=False))))
    assert all(set(sets.prefix(a, frequent, times)) & set(sets.prefix(b, frequent, times)) for a, b in held)
    x, y = (np.array([[len(h), *sets.parity(h).tolist()] for h in side], dtype=np.uint64) for side in zip(*held))
    assert sets.near(x, y).all()
    assert all(sets.may(len(a), sets.wide(a), len(b), sets.wide(b)) for a, b in held)
    strangers = rng.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    assert not sets.may(3000, sets.wide(strangers[0]), 3000, sets.wide(strangers[1]))
    pairs = spark.createDataFrame([(*p, *q) for p, q in zip(x.view(np.int64).tolist(), y.view(np.int64).tolist())], "n_set long, f0 long, f1 long, m long, g0 long, g1 long")
    assert pairs.filter(sets.column(str, {"n_set": "m", "f0": "g0", "f1": "g1"}.get)).count() == len(held)


@pytest.mark.parametrize("bucket", [16, None])
def test_similar_groups_equal_brute_force(spark, bucket):
    rng = random.Random(17)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(2, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    common = " ".join(f"line{k}" for k in range(12))
    rows += [(500 + i, common + " " + " ".join(f"own{i}x{k}" for k in range(3))) for i in range(30)]  # one bucket, few alike
    sets_ = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets_}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets_:
        for j in sets_:
            if i < j and len(sets_[i] & sets_[j]) >= 0.8 * len(sets_[i] | sets_[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows), bucket=bucket).collect()}
    assert got == {i: find(i) for i in sets_}
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def components(sets_, least=0.8):
    parent = {i: i for i in sets_}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets_:
        for j in sets_:
            if i < j and len(sets_[i] & sets_[j]) >= least * len(sets_[i] | sets_[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in sets_}


def test_candidates_of_a_hot_group_grow_with_its_rows_alone(spark, monkeypatch):
    """Copies just beyond the bound, which parities take for near: few link, and a key has all of them."""
    made = spark.sparkContext.accumulator(0)

    def counting(mapper, keep=buckets.lean):
        def run(batches):
            for b in mapper(batches):
                made.add(b.num_rows)
                yield b

        return keep(run)

    monkeypatch.setattr(buckets, "lean", counting)
    each = []
    for n in (60, 240):
        rng = random.Random(n)
        rows = []
        for i in range(n):
            w = [f"w{k}" for k in range(186)] if i % 8 else rows[i - 1][1].split() if i else ["w0"]
            for k in rng.sample(range(len(w)), 13 if i % 8 else 3 if i else 0):
                w[k] = f"x{i}y{k}"
            rows.append((i, " ".join(w)))
        before = made.value
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows), size=1).collect()}
        each.append((made.value - before) / n)
        assert got == components({i: set(t.split()) for i, t in rows}) and len(set(got.values())) > n // 4
    assert each[1] < 2 * each[0], each


def test_sets_of_long_texts_that_share_some_words_are_not_moved(spark, monkeypatch):
    """Parities of few bits cannot tell long texts apart; the wide ones do before any set is read for a crowd."""
    moved = spark.sparkContext.accumulator(0)

    def counting(docs, size, keep=simhash.shingle_sets):
        moved.add(len(docs))
        return keep(docs, size)

    rng = random.Random(29)
    rows = [(i, " ".join(rng.sample([f"w{k}" for k in range(2400)], 800))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + f" more{i}") for i in range(3)]
    monkeypatch.setattr(simhash, "shingle_sets", counting)
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows), size=1).collect()}
    assert groups == {i: i % 100 for i, _ in rows}
    assert moved.value <= 4 * len(rows) + 20, moved.value  # four scans, and the sets of what may be alike


@pytest.mark.parametrize("least", [0.8, 0.3])
def test_wide_parities_of_a_crowd_are_held_against_each_other_as_pairs_are(least):
    rng = np.random.default_rng(31)
    sets = simhash.Sets(4, least)
    held = []
    for n in (90, 130, 600, 1030):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        held += [np.unique(np.concatenate((rng.choice(base, int(n * rng.uniform(0.85, 1)), replace=False), rng.integers(0, 2**64, int(n * rng.uniform(0, 0.1)), dtype=np.uint64)))) for _ in range(12)]
    held = [held[i] for i in rng.permutation(len(held))]
    n, wide = np.array([len(x) for x in held], dtype=np.float64), [sets.wide(x) for x in held]
    component = rng.integers(0, 30, len(held))
    got = [(min(x, y), max(x, y)) for xs, ys in sets.all_may(n, wide, component) for x, y in zip(xs.tolist(), ys.tolist())]
    fits = lambda i, j: min(n[i], n[j]) >= least * max(n[i], n[j]) and sets.may(int(n[i]), wide[i], int(n[j]), wide[j])
    want = {(i, j) for i in range(len(held)) for j in range(i + 1, len(held)) if component[i] != component[j] and fits(i, j)}
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want)


def test_a_crowd_is_connected_as_all_its_pairs_are():
    rng = random.Random(23)
    base = list(range(100))
    sets_ = {i: {x if rng.random() > 0.06 else 1000 * i + x for x in base} for i in range(1, 40)} | {90: set(), 91: {5}}
    texts = [(i, x) for i, x in sets_.items()] + [(91, set(base))]  # an id of two texts
    lengths = np.array([len(x) for _, x in texts])
    pairs = simhash.spanning(np.array([i for i, _ in texts]), np.array([e for _, x in texts for e in sorted(x)]), lengths, 0.8)
    alike = lambda x, y: any(len(s & t) >= 0.8 * len(s | t) for i, s in texts if i == x for j, t in texts if j == y)
    every = [(x, y) for x in sets_ for y in sets_ if x < y and alike(x, y)]
    assert set(pairs) <= set(every) and len(pairs) < len(sets_)

    def reach(edges):
        known = {i: i for i in sets_}
        for _ in sets_:
            for x, y in edges:
                known[x] = known[y] = min(known[x], known[y])
        return known

    assert reach(pairs) == reach(every) and len(set(reach(every).values())) > 1


def test_components_of_edges(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500)]
    got = {r.node: r.component for r in graph.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    assert graph.connect(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substring dedup


def best_chain(a, b, k=substring.K):
    n = len(a)
    score = [0.0] * n
    for i in sorted(range(n), key=lambda i: (a[i], b[i])):
        score[i] = k + max([0.0] + [score[j] - substring.GAP * (a[i] - a[j] + b[i] - b[j]) for j in range(n) if a[j] < a[i] and b[j] < b[i]])
    return max(score)


def test_chains_are_best_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        pairs = list({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 25))})
        pairs.sort()
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        found = substring.chains(a, b)
        assert sorted(i for c in found for i in c.tolist()) == list(range(len(a)))

        def value(c):
            return substring.K * len(c) - substring.GAP * sum(int(a[y] - a[x] + b[y] - b[x]) for x, y in zip(c, c[1:]))

        assert all((np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all() for c in found)
        assert max(value(c.tolist()) for c in found) == pytest.approx(best_chain(a.tolist(), b.tolist()))


def test_seeds_do_not_depend_on_neighbours():
    docs = [prose(random.Random(i), 80 + i).encode() for i in range(5)] + [b"", b"one two", b"a b c d e f"]
    t, p, h = substring.seeds(docs)
    for i, d in enumerate(docs):
        own = substring.seeds([d])
        assert sorted(zip(p[t == i].tolist(), h[t == i].tolist())) == sorted(zip(own[1].tolist(), own[2].tolist()))
    assert (t == 7).sum() == 1 and (t >= 5).sum() == 1


def passage_rows():
    rng = random.Random(11)
    p = prose(rng, 70)
    fuzzy = p.split()
    for k in (10, 31, 32, 55):
        fuzzy[k] = f"other{k}"
    del fuzzy[44]
    loop = "is onhe " * 60
    rows = [(i, prose(rng, 150)) for i in range(30)]
    rows += [(100, f"{prose(rng, 60)} {p} {prose(rng, 40)}"), (101, f"{prose(rng, 30)} {p} {prose(rng, 80)}"), (102, f"{prose(rng, 50)}\n{' '.join(fuzzy)}. {prose(rng, 50)}"), (103, p)]
    rows += [(110, f"{prose(rng, 20)} {loop} {prose(rng, 20)}"), (111, f"{prose(rng, 25)} {loop} {prose(rng, 30)}"), (112, prose(rng, 30) + " is onhe is onhe is onhe is onhe " + prose(rng, 30))]
    rows += [(120, rows[0][1]), (121, rows[0][1]), (130, None), (131, ""), (132, "?!"), (None, rows[1][1]), (140, prose(rng, 20_000)), rows[5], rows[5]]
    return rows, p


def test_repeated_passages(spark):
    rows, p = passage_rows()
    got = defaultdict(list)
    for r in substring.repeats(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert set(got) == {101, 102, 103, 111, 120, 121}
    for i, least in ((101, 70), (102, 60), (103, 70), (111, 118), (120, 150), (121, 150)):
        assert sum(r.n_words for r in got[i]) >= least
    assert sum(r.n_words for r in got[101]) <= 76 and got[101][0].sources == [100]
    assert substring.repeats(frame(spark, [])).count() == 0


def test_every_exact_repeat_is_found_whoever_held_its_parts_first(spark):
    """A passage whose every part of 30 words stood in another document before it was whole."""
    rng = random.Random(31)
    passage = [f"p{k}" for k in range(120)]
    rows = [(i, prose(rng, 40) + " " + " ".join(passage[at : at + 30]) + " " + prose(rng, 40)) for i, at in enumerate(range(0, 91, 10))]
    rows += [(50, prose(rng, 33) + " " + " ".join(passage) + " " + prose(rng, 20)), (51, prose(rng, 7) + " " + " ".join(passage[30:85]) + " " + prose(rng, 60)), (52, " ".join(passage[61:113]))]
    rows += [(60 + i, prose(rng, 30) + " " + " ".join(f"s{k}" for k in range(9 * i, 9 * i + 24)) + " " + prose(rng, 30)) for i in range(6)]
    words = {i: t.split() for i, t in rows}
    want = {}
    for i, own in words.items():
        before = {tuple(w[k : k + 50]) for j, w in words.items() if j < i for k in range(len(w) - 49)}
        hit = {p for k in range(len(own) - 49) if tuple(own[k : k + 50]) in before for p in range(k, k + 50)}
        if hit:
            want[i] = hit
    assert set(want) == {51, 52}
    got = defaultdict(set)
    for r in substring.repeats(frame(spark, rows)).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    assert all(want[i] <= got[i] for i in want)
    assert set(got) <= {50, 51, 52, *range(61, 66)}


def test_texts_of_one_id_each_have_their_passages(spark):
    rng = random.Random(12)
    one, two = prose(rng, 80), prose(rng, 80)
    rows = [(1, prose(rng, 20) + " " + one), (2, two + " " + prose(rng, 30)), (3, prose(rng, 15) + " " + one), (3, two + " " + prose(rng, 25)), (3, prose(rng, 40)), (4, prose(rng, 50))]
    for parts in (1, 3):
        df = frame(spark, rows).repartition(parts)
        got = sorted((r.doc_id, r.start, r.end) for r in substring.repeats(df).collect())
        assert len(got) == 2 and [x[0] for x in got] == [3, 3] and got[0][1] == 0 and abs(got[1][1] - 15) <= 2
        left = [r.text for r in substring.cleaned(df).collect() if r.doc_id == 3]
        assert len(left) == 3 and rows[4][1] in left and not any(one in t or two in t for t in left)


def test_no_join_of_passages_finds_shuffle_files_of_the_step_before(spark, monkeypatch):
    """The first holders of seeds and of runs are shuffled apart from the joins with them."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {p for d in disk.localDirsString() for p in Path(d).glob("*/shuffle_*.data")}
    substring.ship(spark)
    rows = substring._rows(frame(spark, passage_rows()[0]), "doc_id", "text").cache()
    rows.count()
    substring.settle(spark)
    left, made = [], set()

    def looking(df, keep=substring.table):
        before = held()
        if {"src_at", "equal"} & set(df.columns):  # what the joins with seeds and with runs find
            for _ in range(50):  # files go a moment after memory is collected
                if not made & held():
                    break
                time.sleep(0.1)
            left.append(len(made & held()))
        out = keep(df)
        if "src_pos" in df.columns:
            made.update(held() - before)
        return out

    monkeypatch.setattr(substring, "table", looking)
    found = substring._pieces(rows)
    assert made and left == [0, 0] and found.count()
    rows.unpersist()


def test_long_runs_are_those_whose_inner_seeds_are_marked():
    docs = [prose(random.Random(i), 150).encode() for i in range(3)]
    t, p, h = substring.seeds(docs)
    words = len(substring.Words([docs[1]]).start)

    def found(kept):
        bitmap = np.zeros(1 << 14, dtype=np.uint64)
        for x in (kept & np.uint64(64 * len(bitmap) - 1)).tolist():
            bitmap[x >> 6] |= np.uint64(1 << (x & 63))
        rt, rp, _ = substring.long_runs(docs, bitmap)
        return set(rp[rt == 1].tolist())

    every = set(range(words - 49))
    assert found(h) == every
    for i in (0, 3, 9):
        lost, at = h[t == 1][i], int(p[t == 1][i])
        assert found(h[h != lost]) == every - set(range(at - 33, at - 10))


def test_a_repeated_run_has_the_same_inner_seeds_everywhere():
    rng = random.Random(2)
    for _ in range(40):
        run = prose(rng, 60).split()[:50]
        docs = [" ".join(prose(rng, rng.randrange(30)).split() + run + prose(rng, rng.randrange(30)).split()).encode() for _ in range(2)]
        t, p, h = substring.seeds(docs)
        inner = []
        for i, d in enumerate(docs):
            start = d.decode().lower().split().index(run[0].lower()) if d.decode().split().count(run[0]) == 1 else None
            own = sorted(zip(p[t == i].tolist(), h[t == i].tolist()))
            begin = next(k for k in range(len(d.split()) - 49) if d.decode().split()[k : k + 50] == run)
            assert start is None or start == begin
            inner.append([(x - begin, y) for x, y in own if begin + 11 <= x <= begin + 33])
        assert inner[0] == inner[1] and inner[0]


def test_cleaned_documents_lose_the_passages_alone(spark):
    rows, p = passage_rows()
    df = frame(spark, rows)
    kept = substring.cleaned(df)
    assert kept.columns == df.columns
    after = defaultdict(list)
    for r in kept.collect():
        after[r.doc_id].append(r)
    before = {i: t for i, t in ((r[0], r[1]) for r in rows)}
    assert {i for i in before if i not in after} == {103, 120, 121}
    for i, own in after.items():
        if i not in (101, 102, 111):
            assert all(r.text == before[i] for r in own)
    assert sum(p in (r.text or "") for own in after.values() for r in own) == 1
    assert len(after[5]) == 3
    cut = after[101][0]
    assert cut.n_chars == len(cut.text) and len(cut.text.split()) >= 104


# --- pipeline


def test_pipeline_stages_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(260):
        toxic = int(i % 5 == 0)
        w = prose(rng, 90).split()
        if toxic:
            for _ in range(4):
                w[rng.randrange(90)] = rng.choice(["idiotxx", "scumyy"])
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
        labels.append((i, 1, toxic))
    rows += [(900, "12345 !!", None, "s0"), (901, rows[1][1], "en", "s0"), (902, rows[2][1] + " one more", "en", "s1"), (903, None, None, None)]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    names = []
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        names.append(name)
        seen[name] = [r.doc_id for r in docs.collect()]
        assert name == names[-1] and (docs.columns == columns or name == corpus_pipeline.STAGES[-1][0])
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(seen["toxicity"])) <= 3 and len(set(range(260)) - toxic - set(seen["toxicity"])) <= 5
    assert {900, 903}.isdisjoint(seen["language_id"]) and len(seen["toxicity"]) - len(seen["language_id"]) == 2
    assert not {901, 902} & set(seen["simhash_near_dedup"])
    assert set(seen["best_fit_packing"]) == set(seen["substring_dedup"])
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == columns)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.collect()) == sorted(seen["best_fit_packing"])


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
