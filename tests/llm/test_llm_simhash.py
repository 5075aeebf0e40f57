"""SimHash against brute force, and its odd inputs."""

import numpy as np
import pandas as pd
import pytest
import xxhash

from reelsleuth.llm import simhash as S
from reelsleuth.llm.components import connected_components

ODD = [(1, "the cat sat on the mat", "x"), (1, "the cat sat on the mat", "x"), (2, None, None), (3, "", "y"), (None, "alone here", "z"), (4, "word " * 30_000, None), (5, "THE CAT\tsat\non the mat", "q"), (6, "één ünï", "r")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like results."""
    return spark.createDataFrame(ODD, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")


def slow(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "a", "a b", "a b c", "a b c d e f g a b c", "É é A a", "x " * 999])
def test_fingerprint(text):
    assert S.simhash64(text) == slow(text)


def groups(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in values}


@pytest.mark.parametrize("leaf", [8, 64, 100_000])
def test_links_join_the_same_groups_as_all_pairs(spark, leaf):
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 2**63, 150, dtype=np.int64)
    flips = [np.int64(b) ^ np.int64(1 << int(rng.integers(0, 62))) ^ np.int64(1 << int(rng.integers(0, 62))) for b in base[:80]]
    chain = [np.int64((1 << k) - 1) for k in range(40)]  # each within a bit of the next
    fps = np.unique(np.array([*base, *flips, *chain], np.int64))
    found = S.links(spark.createDataFrame(pd.DataFrame({"node": fps, "fp": fps})), leaf=leaf).toPandas()
    mask = (1 << 64) - 1
    assert all(((int(a) ^ int(b)) & mask).bit_count() <= 3 for a, b in zip(found.a, found.b))
    want = groups([int(f) & mask for f in fps], 3)
    roots = {int(f) & mask: int(f) & mask for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in zip(found.a, found.b):
        x, y = find(int(a) & mask), find(int(b) & mask)
        roots[max(x, y)] = min(x, y)
    assert {f: find(f) for f in roots} == want


def test_a_clique_leaves_as_a_forest():
    fps = np.array([1 << k for k in range(60)], np.uint64)  # all pairs differ in two bits
    a, b = S.leaf_edges(fps[:, None], np.ones(60, bool), 3)
    assert len(a) == 59


def test_odd_rows(odd):
    got = S.near_duplicates(odd).toPandas()
    assert len(got) == len(ODD)
    by = {(None if pd.isna(i) else int(i)): (f, c) for i, f, c in zip(got.doc_id, got.fingerprint, got.component_id)}
    assert by[2] == by[3] == ("0" * 16, 2) and by[1][1] == by[5][1] == 1 and pd.isna(by[None][1])
    kept = S.one_of_each(odd)
    assert kept.columns == ["doc_id", "text", "component_id"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "6", "None"]


def test_empty_table(odd):
    assert S.near_duplicates(odd.limit(0)).count() == 0 and S.near_copies(odd.limit(0)).count() == 0 and S.one_of_each(odd.limit(0)).count() == 0


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_wide_fingerprints_follow_the_set_of_shingles():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    body = " ".join(f"w{k}" for k in rng.integers(0, 500, 400))
    texts = [None, "", "A b", "a  B", body, body.upper(), body + " " + body, "x " * 200_000, "x x x x x", "a b c d"]
    got = S.wide_fingerprints(pa.array(texts), 5)
    assert not got[:2].any() and (got[2] == got[3]).all() and (got[4] == got[5]).all() and (got[7] == got[8]).all() and (got[2] != got[9]).any()
    each = [S.wide_fingerprints(pa.array([t]), 5)[0] for t in texts]
    assert (np.array(each) == got).all()
    assert int(np.bitwise_count(got[4] ^ got[6]).sum()) < 30 < int(np.bitwise_count(got[4] ^ got[9]).sum())


@pytest.mark.parametrize("nulls", [False, True])
def test_slices_of_a_batch_keep_their_texts(nulls):
    """Batches are read some megabytes at a time: texts after the first slice are as good as those in it."""
    import pyarrow as pa

    from reelsleuth.llm.quality import slices, symbols

    rng = np.random.default_rng(6)
    texts = [None if nulls and k % 7 == 3 else " ".join(f"W{i}" for i in rng.integers(0, 500, 30)) for k in range(40)]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], names=["text"])
        parts = [x.column("text") for x in slices(batch, 700)]
        assert len(parts) > 5
        for find in (lambda t: symbols(t)[0], lambda t: symbols(t, lower=True)[0], lambda t: S.wide_fingerprints(t, 5), lambda t: S._wide(t, 5)[1]):
            assert (np.concatenate([find(x) for x in parts]) == find(pa.array(texts))).all()
        assert len(set(np.concatenate([S._wide(x, 5)[1] for x in parts]).tolist())) == len(set(texts))


def test_clean_documents_of_a_long_batch_stay(spark):
    """Texts that share no shingle stay, wherever in a batch of over 4 MB they lie; of copies one does."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 3000)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[::40]])), "doc_id long, text string").coalesce(1)
    assert sorted(r["doc_id"] for r in S.one_of_each(docs).collect()) == list(range(400))


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):
        words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        texts.append(" ".join(words))
        for share in (0.005, 0.015, 0.025, 0.12):
            texts.append(" ".join("new" + w if rng.random() < share else w for w in words))
    sets = [shingles(t) for t in texts]
    got = S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    near, far = [], []
    for i, a in enumerate(sets):
        for j in range(i):
            j_of = len(a & sets[j]) / len(a | sets[j])
            (near if j_of >= 0.8 else far if j_of < 0.6 else []).append(got[i] == got[j])
    assert len(near) > 100 and np.mean(near) >= 0.93 and np.mean(far) < 0.02


def like(x, y):
    return x == y or bool(x | y) and len(x & y) >= 0.8 * len(x | y)


@pytest.mark.parametrize("many", [0, 4])
def test_near_copies_are_all_pairs_of_the_threshold(spark, many, monkeypatch):
    """Pairs near the threshold on either side, short texts, and a group of which all share most shingles."""
    monkeypatch.setattr(S, "MANY_PAIRS", many)
    rng = np.random.default_rng(5)
    texts = [None, "", "a b", "A  b", "a b c", "one two three four five six"]
    for size in (12, 30, 60, 200):
        for _ in range(25):
            words = [f"w{k}" for k in rng.integers(0, 5000, size)]
            texts.append(" ".join(words))
            for _ in range(3):
                cut = int(rng.integers(0, size // 5 + 1))  # a changed end: likeness about (size - cut) / (size + cut)
                texts.append(" ".join(words[: size - cut] + [f"n{k}" for k in rng.integers(0, 10**6, cut)]))
    common = [f"c{k}" for k in range(60)]
    texts += [" ".join(common + [f"u{j}_{k}" for k in range(int(rng.integers(0, 14)))]) for j in range(60)]
    sets = [frozenset(shingles(t or "")) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if like(x, sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    assert got.to_dict() == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("many", [0, 4])
def test_texts_that_are_almost_alike_do_not_meet_in_pairs(spark, many, monkeypatch):
    """200 variants of a text, most pairs at a likeness of 0.7: few pairs are laid side by side, and no link is lost."""
    monkeypatch.setattr(S, "MANY_PAIRS", many)
    alike, met = S._alike, []

    def counted(pairs, *rest):
        met.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(S, "_alike", counted)
    rng = np.random.default_rng(9)
    body, texts = [f"w{k}" for k in range(120)], []
    for j in range(200):
        words = list(body)
        for k in rng.choice(120, int(rng.choice([1, 2, 3], p=[0.02, 0.9, 0.08])), replace=False):
            words[k] = f"n{j}_{k}"
        texts.append(" ".join(words))
    sets = [frozenset(shingles(t)) for t in texts]
    pairs = [(j, i) for i, x in enumerate(sets) for j in range(i) if like(x, sets[j])]
    assert 100 < len(pairs) < 5000
    low = connected_components(spark.createDataFrame(pairs, "a long, b long")).toPandas().set_index("node").root
    got = S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    assert got.to_dict() == {i: int(low.get(i, i)) for i in range(200)}
    assert sum(met[1:]) < 10 * len(texts)  # the first are those that fingerprints offer


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3), (100, 101)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_few_links_are_joined_by_the_driver(spark, monkeypatch):
    """The same roots, without a single round."""
    import reelsleuth.llm.components as C

    rng = np.random.default_rng(8)
    edges = [*((int(a), int(b)) for a, b in rng.integers(-500, 500, (400, 2))), *((i, i + 1) for i in range(10_000, 10_300)), (7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    slow = {(r["node"], r["root"]) for r in connected_components(frame).collect()}
    monkeypatch.setattr(C, "_star", None)
    got = [(r["node"], r["root"]) for r in connected_components(frame, few=1000).collect()]
    assert len(got) == len(slow) and set(got) == slow
    assert connected_components(frame.where("a is null"), few=1000).count() == 0
