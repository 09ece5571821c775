"""The audit against plain counting, and the joint walk of the trees against all cells."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickloom.llm import common, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, row int, p double"


def by_hand(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang = lang or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang, source or ""].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        here = {s: c for (l, s), c in groups.items() if l == lang}
        whole = sum(here.values(), Counter())
        def freq(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        q, p = freq(whole), {s: freq(c) for s, c in here.items()}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in here:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in here if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if here[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, i) for i, (x, v) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def audited(spark, rows, least, top):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(6), least, top).collect()))


def test_odd_rows_ties_and_languages(spark):
    rnd = random.Random(2)
    words = ["Haus", "haus", "HÄUS", "häus", "ſ", "K", "a", "b", "é", "東京", "x" * 5000, "it's", "9lives", "[", "`", "\x00", "\x7f", "\x80"]
    rows = [(i % 40, " ".join(rnd.choice(words) for _ in range(rnd.randrange(12))), rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "é", "z", None, ""]), 1, 2, 3.0) for i in range(300)]
    rows += [(None, None, "en", "silent", None, None, None), (7, "", "fr", "only", 0, 0, 0.0), (8, "rare words", "es", "one", 0, 0, 0.0), (9, "", "es", "two", 0, 0, 0.0)]
    rows += [rows[0]] * 15 + [(1, "long " * 400_000 + "tail", "de", "a", 0, 0, 0.0)]
    for least, top in ((10, 10), (1, 3)):
        assert audited(spark, rows, least, top) == by_hand(rows, least, top)
    assert divergence.audit(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_more_sources_than_a_band_and_more_terms_than_a_run(spark):
    rnd = random.Random(4)
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, " ".join(letters(rnd.randrange(9)) for _ in range(rnd.randrange(5))), "wide", f"s{i % 300}", 0, 0, 0.0) for i in range(900)]
    n = divergence.SIDE * divergence.RUN + 700
    rows += [(i, " ".join(letters(x) for x in range(i, n, 1 + i)), "long", f"s{i % 3}", 0, 0, 0.0) for i in range(4)]
    assert audited(spark, rows, 1, 5) == by_hand(rows, 1, 5)


def test_pieces_end_between_terms():
    text = "One twothreefour  ÄÖÜßé 12ab".encode() * 9
    assert sum(common.term_lists(text, 7), []) == text.translate(common.TERM_BYTES).split()
    assert list(common.term_lists(b"")) == []


@pytest.mark.parametrize("shape,width", [((20, 20), 256), ((256, 30), 100), ((5, 256), 17), ((1, 1), 1)])
@pytest.mark.parametrize("share", [0.0, 0.001, 0.2, 1.0])
def test_joint_walk(shape, width, share):
    rng = np.random.default_rng(1)
    squares, dense = [], []
    for rows in shape:
        unseen = rng.integers(1, 10**6, rows)
        slots, cols = np.nonzero(rng.random((rows, width)) < share)
        p = rng.integers(1, 10**9, len(slots))
        squares.append(divergence.Square(unseen, slots, cols, p))
        full = np.repeat(unseen[:, None], width, axis=1)
        full[slots, cols] = p
        dense.append(full)
    sums, seen = np.zeros(shape, np.int64), []
    divergence.walk(*squares, width, sums, False, lambda *x: seen.append(x))
    a, b = dense
    want = np.array([[sum(int(x - y) ** 2 // int(x + y) for x, y in zip(r, s)) for s in b[:6]] for r in a[:6]])
    assert (sums[:6, :6] == want).all()
    covered = np.zeros((*shape, width), int)
    for size, i, j, c, _ in seen:
        covered[i * size : (i + 1) * size, j * size : (j + 1) * size, c * size : (c + 1) * size] += 1
    assert (covered == 1).all()  # each pair of cells in exactly one leaf or square of zeros
    if share == 0:
        assert len(seen) == 1 and not seen[0][4]
    same = np.zeros((shape[0], shape[0]), np.int64)
    divergence.walk(squares[0], squares[0], width, same, True)
    full = np.zeros_like(same)
    divergence.walk(squares[0], squares[0], width, full, False)
    assert (np.triu(same) == np.triu(full)).all()
