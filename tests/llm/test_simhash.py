import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from orbweave.llm import simhash
from orbweave.llm.simhash import allocate, fingerprint, links, near_duplicates

MASK = (1 << 64) - 1


def brute_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < words else [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    h = [xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ["", " \t", "A", "a B c", "The quick brown fox jumps over the lazy dog THE quick", "É x y é", "a b c " * 300, "a\x85b c d e"]:
        assert fingerprint(t.encode()) == brute_fingerprint(t)


def test_allocate_meets_the_sum():
    cost, t = allocate([[5.0, 50.0], [9.0, 10.0], [1.0, 90.0]], -1)
    assert sum(t) == -1
    assert cost == 6.0


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0, MASK]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    want = {tuple(sorted((a, b), key=lambda x: x - (1 << 64) * (x >> 63))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = [(r.a & MASK, r.b & MASK) for r in links(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_links_with_unequal_thresholds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "scheme", lambda fps, d: ([list(range(32)), list(range(32, 64))], [0, 2]))
    df = spark.createDataFrame([(0,), (7 << 40,), (1,), (3 << 50 | 1,), (15,)], "fp long")
    assert {(r.a, r.b) for r in links(df).collect()} == {(0, 7 << 40), (0, 1), (0, 3 << 50 | 1), (1, 3 << 50 | 1), (1, 15)}


def test_near_duplicates_of_odd_tables(spark):
    rows = [(5, "a b c d", 1), (3, "a b c d", 2), (3, "a b c d", 2), (9, None, 3), (8, "", 4), (7, " \n", 5), (None, "z y x", 6), (11, "q " * 50_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect()), key=str)
    comp = {"a b c d": 3, None: 7, "": 7, " \n": 7, "z y x": None, "q " * 50_000: 11}
    want = sorted(((d, f"{brute_fingerprint(t or ''):016x}", comp[t]) for d, t, _ in rows), key=str)
    assert got == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (9, "other words entirely here now ok", None), (None, "alone in here with no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
    assert got == sorted([rows[1], rows[3], rows[4]], key=str)


def test_keep_one_finds_what_is_similar(spark):
    """Against brute force over all pairs: groups at 0.85 and more are merged, documents under 0.7 stay apart."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        texts.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, " ".join(t), "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]

    def groups(least):
        label = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    x, y = sorted((label[a], label[b]))
                    label = [x if v == y else v for v in label]
        return {k for k, v in enumerate(label) if k == v}

    got = {r.doc_id for r in simhash.keep_one(df.repartition(3)).collect()}
    assert groups(0.7) <= got <= groups(0.87)
    assert len(got) < len(texts) - 20
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_partitions_keep_the_recall_at_any_size():
    for n in (2, 10**4, 10**6, 16 * 10**6, 256 * 10**6, 10**10):
        width, parts = simhash.partitions(n, 0.8, 0.98)
        assert 1 - (1 - (1 - np.arccos(1.6 / 1.8) / np.pi) ** width) ** parts >= 0.98
        assert parts * width <= simhash.SIGNS - 128
    with pytest.raises(ValueError):
        simhash.partitions(100, 0.1, 0.98)


def test_correlated_signs_share_a_group():
    """Signs that copy one of the sources of their pool, with noise, are grouped by source; every sign is used once."""
    rng = np.random.default_rng(7)
    width, parts = simhash.partitions(1000, 0.8, 0.99)
    bits = rng.integers(0, 2, (2000, simhash.SIGNS)).astype(np.uint8)
    source = {}
    for a in range(0, parts, simhash.POOL):
        some = min(simhash.POOL, parts - a)
        source |= {j: (a, j % some) for j in range(a * width, (a + some) * width)}
    copied = rng.integers(0, 2, (2000, parts)).astype(np.uint8)
    for j, (a, k) in source.items():
        bits[:, j] = copied[:, a + k] ^ (rng.random(2000) < 0.1)
    found = simhash.arranged(bits, 1000, 0.8, 0.99)
    assert sorted(j for g, _ in found for j in g) == list(range(len(found) * width))
    assert all(len(g) == width and len({source[j] for j in g}) == 1 for g, _ in found)
    assert len(found) + sum(t for _, t in found) == parts


def test_thresholds_leave_out_a_group_that_all_share():
    """Ten signs are the same everywhere: to probe a neighbour more widely costs less than to compare all with all there."""
    rng = np.random.default_rng(9)
    width, parts = simhash.partitions(1000, 0.8, 0.99)
    bits = rng.integers(0, 2, (1000, simhash.SIGNS)).astype(np.uint8)
    assert [t for _, t in simhash.arranged(bits, 1000, 0.8, 0.99)] == [0] * parts
    constant = set(range((parts - 1) * width, parts * width))
    bits[:, sorted(constant)] = 1
    found = simhash.arranged(bits, 1000, 0.8, 0.99)
    assert sorted(t for _, t in found) == [0] * (parts - 2) + [1]
    assert not constant & {j for g, _ in found for j in g}


def test_keep_one_probes_within_thresholds(spark, monkeypatch):
    """All similar pairs that are within the threshold of a group are found, and nothing that isn't similar."""
    groups = [(list(range(0, 24, 2)), 1), (list(range(30, 42)), 0), (list(range(1, 24, 2)), 2)]
    monkeypatch.setattr(simhash, "arranged", lambda *_: groups)
    rng = random.Random(10)
    word = lambda: f"{rng.getrandbits(40):x}"
    texts = []
    for _ in range(120):
        base = [word() for _ in range(200)]
        texts += [base, base[:-18] + [word() for _ in range(18)]]
    signs = [np.unpackbits(np.frombuffer(simhash.long_fingerprint(simhash.shingles(" ".join(t).encode(), 5))[1], np.uint8)) for t in texts]
    near = [[k for k in range(0, 240, 2) if any((signs[k][g] != signs[k + 1][g]).sum() <= (t if wide else 0) for g, t in groups)] for wide in (True, False)]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(k, " ".join(t), "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)).collect()}
    gone = set(range(240)) - got
    assert {k + 1 for k in near[0]} <= gone <= set(range(1, 240, 2))
    assert len(near[1]) < len(near[0]) < 120


def labels_of(nodes, pairs):
    label = {x: x for x in nodes}
    while True:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            return label


@pytest.mark.parametrize(("block", "groups"), [(4096, None), (24, None), (24, ([list(range(32)), list(range(32, 64))], [0, 2]))])
def test_connected_is_what_links_connect(spark, monkeypatch, block, groups):
    """Dense groups, cut into blocks that meet, against all pairs; the output grows with the fingerprints only."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    if groups:
        monkeypatch.setattr(simhash, "scheme", lambda fps, d: groups)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) >> 1 for _ in range(60)}
    for c in list(fps)[:6]:
        for _ in range(120):
            x = c
            for b in rng.sample(range(60), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = labels_of(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    found = [(r.u, r.v) for r in simhash.connected(df).collect()]
    assert all((a ^ b).bit_count() for a, b in found)
    assert labels_of(fps, found) == want


def test_similar_sets_in_blocks(spark, monkeypatch):
    from orbweave.llm import meeting

    monkeypatch.setattr(meeting, "MEMBERS", 20)
    monkeypatch.setattr(meeting, "SMALL", 30)
    rng = np.random.default_rng(2)
    template = rng.integers(1, 1 << 60, 80)
    sets, members = {}, []
    for k in range(300):  # a family below the threshold, with pairs above it inside
        own = rng.integers(1, 1 << 60, 30 if k % 3 else 26)
        if k % 3 == 1:
            own = np.concatenate([np.frombuffer(sets[k - 1], np.uint64)[-0:].astype(np.int64), rng.integers(1, 1 << 60, 10)])
            sets[k] = np.unique(own.astype(np.uint64)).tobytes()
        else:
            sets[k] = np.unique(np.concatenate([template, own]).astype(np.uint64)).tobytes()
        members += [(v, k, k if k % 7 else 0) for v in ({1, 2 + k // 40} if k % 5 else {1})]
    arrays = {k: set(np.frombuffer(x, np.uint64).tolist()) for k, x in sets.items()}
    near = [(a, b) for a in sets for b in sets if a < b and len(arrays[a] & arrays[b]) >= 0.8 * len(arrays[a] | arrays[b])]
    label = {k: lab for _, k, lab in members}
    given = [(k, v) for k, v in label.items() if k != v]
    want = labels_of(sets, near + given)
    got = meeting.similar_sets(spark.createDataFrame(members, "value long, k long, label long").repartition(3), spark.createDataFrame(list(sets.items()), "k long, h binary"), 0.8).collect()
    assert near and all(want[u] == want[v] for u, v in map(tuple, got))
    assert labels_of(sets, [tuple(r) for r in got] + given) == want


def test_a_family_below_the_similarity_keeps_its_pairs(spark):
    """Many texts share a template, at about 0.7 with each other; pairs above 0.8 among them are all found, and nothing else goes."""
    rng = random.Random(6)
    word = lambda: f"w{rng.getrandbits(30)}"
    template = [word() for _ in range(250)]
    texts, want = [], set()
    for k in range(400):
        text = template + [word() for _ in range(52)]
        want.add(len(texts))
        texts.append(text)
        if k % 8 == 0:
            texts.append(text[:-8] + [word() for _ in range(8)])
    df = spark.createDataFrame([(k, " ".join(t), "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id for r in simhash.keep_one(df.repartition(3)).collect()} == want


def test_keep_one_with_clashing_columns(spark):
    rows = [(5, "a b c d e f", "x", 1, 2), (3, "a b c d e f", "z", 3, 4), (3, "a b c d e f", "y", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _th int, id int")
    assert [tuple(r) for r in simhash.keep_one(df).collect()] == [rows[2]]
