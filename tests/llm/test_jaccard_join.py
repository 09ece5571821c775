import random
import re

import numpy as np
import pytest

from tickloom.llm import jaccard_join
from tickloom.llm.jaccard_join import Join, Leaves, drop_near_copies, leaf_keys, near_duplicates, shingle_sets


def brute(rows, join):
    """component_id and set size of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + join.words]) for i in range(len(w) - join.words + 1)} if len(w) >= join.words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and join.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Äé", "ß"]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 4, 6, 10, 15, 30, 80, 200]))] for _ in range(40)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (4, "one TWO"), (5, "one two three"), (6, "x" * 40)]
    for i in range(10, n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            k = rnd.randrange(max(1, len(w)))
            w[k : k + 1] = rnd.choice([[], [rnd.choice(vocab)], [*w[k : k + 1], rnd.choice(vocab)]])
        out.append((i, rnd.choice([" ", "\n", "  "]).join(w if rnd.random() < 0.8 else [x.upper() if x.isascii() else x for x in w])))
    return out


@pytest.mark.parametrize("join", [Join(), Join(3, 9, 10)])
def test_components_against_all_pairs(spark, join):
    rows = corpus(join.words)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), join)
    assert sorted(map(tuple, got.collect())) == brute(rows, join)


@pytest.mark.parametrize("join", [Join(), Join(3, 9, 10), Join(1, 1, 2)])
def test_linked_sets_share_a_leaf(join):
    rnd = random.Random(1)
    leaves = Leaves(join)
    for _ in range(1500):
        n = rnd.choice([1, 2, 3, 5, 9, 17, 40, 150])
        a = [str(rnd.random()) for _ in range(n)]
        b = [x for x in a if rnd.random() > rnd.choice([0, 0.05, 0.1])] + [str(rnd.random()) for _ in range(rnd.choice([0, 0, 1, 2, n // 8]))]
        x, y = shingle_sets([" ".join(a).encode(), " ".join(b).encode()], 1)
        if len(x) and len(y) and join.linked(len(set(x) & set(y)), len(x), len(y)):
            assert set(leaf_keys(x, leaves)) & set(leaf_keys(y, leaves))


def test_empty_table_and_hot_group(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node string")
    assert near_duplicates(empty).count() == 0
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: i % 100], f"u{i}", *base[i % 100 + 1 :]])) for i in range(700)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Join()).collect()
    assert {r.component_id for r in got} == {0}


def scattered(n=300):
    """One passage that all share, with own words around it: all meet in leaves, few are linked."""
    rnd = random.Random(8)
    core = [f"c{i}" for i in range(60)]
    families = [[f"f{k}_{i}" for i in range(rnd.choice([14, 16, 18, 40]))] for k in range(25)]
    rows = []
    for i in range(n):
        own = list(families[rnd.randrange(25)])
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(len(own))] = f"x{rnd.random()}"
        rows.append((i, " ".join(core + own)))
    return rows


@pytest.mark.parametrize("size", [8 << 20, 20_000])
def test_open_leaves_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
    rows, join = scattered(), Join(3, 4, 5)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), join)
    assert sorted(map(tuple, got.collect())) == brute(rows, join)


def test_a_block_gives_one_link_a_join():
    """What a pass over all members gives is a forest that joins the components of all linked pairs."""
    join, rows = Join(3, 4, 5), scattered(200)
    sets = shingle_sets([t.encode() for _, t in rows], join.words)
    block = jaccard_join._Block(join, -1)
    for i, s in enumerate(sets):
        block.add(i, i, s)
    links = block.among()
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        assert join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
        assert find(i) != find(j)  # so links are fewer than members
        root[find(i)] = find(j)
    want = {d: c for d, _, c in brute(rows, join)}
    least = {}
    for i in range(len(sets)):
        least.setdefault(find(i), i)
    assert {i: least[find(i)] for i in range(len(sets))} == want


def test_null_and_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(None, a), (None, a + " z"), (None, b), (5, a), (5, b), (5, "c d e f g h"), (6, None), (None, None)]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), Join()).collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={d!r}, text={t!r})" for d, t in [(5, a), (5, b), (5, "c d e f g h"), (6, None), (None, None)])
