"""Secret scan: fixed forms of keys, and values in a credential's place that would take many guesses.

What a value costs to guess is the cheapest way to say it as a row of segments, found by dynamic programming over its
characters: words of the corpus (also in upper case or with digits and signs for letters), dates, repeats of what stood
just before, walks over the keyboard, and characters by brute force. A cost is in bits, so segments add up. A value that
costs ``least_bits`` or more is reported as a span of kind ``guess``, unless a fixed form already covers all of it.

The words are those that make up at least one in ``ONE_IN`` of all word occurrences outside credential values, in all
documents: there can't be more than ``ONE_IN`` of them, however large the corpus, so they are broadcast. A word costs
what its share says. Texts are read twice, once for the words and once for the spans, and never shuffled.

Odd rows: a null text counts as empty and has no spans. Rows that repeat are scanned alike, one row each; their words
count each time. Only id and text are read, so further columns may have any name. A text is one value, decoded once;
batches are cut by bytes. A value's search ends as soon as no way can stay below the limit, so a very long value costs
little unless it is cheap, and then time in proportion to its length. An empty table has no words and no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from math import inf, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, stored, term_lists

#: Fixed values, set by the contract: form, flags, group and its least length, and what a text must hold in lower case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched from its first character, so shorter ones can be passed over
FORMS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
KINDS = [*(f[0] for f in FORMS), "guess"]

#: A credential's place: a name with a sign of assignment, or the user part of a URL. Values end at white space, quotes
#: and angle brackets; what closes a sentence around them is no part of them.
PLACES = re.compile(r"""(?:passw(?:or)?d|passphrase|passcode|secret|token|credentials?|(?:api|access|private|auth)[_-]?key|(?<![a-z])(?:pass|pwd|auth))"""
                    r"""["']?\x20*(?:=>|[:=])\x20*["']?([^\s"'<>]{6,})|://[^\s/:@]+:([^\s/@"'<>]{6,})@""", re.A | re.I)
AROUND = ".,;:)]}"
#: One of these stands, in lower case, in every text with a match of ``PLACES``, and of ``ASSIGN``.
HINTS, ASSIGN_HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key", b"://"), (b"passw", b"secret", b"token", b"api")

#: Words are shares of at least one in so many; also the greatest number of words.
ONE_IN = 100_000
LEAST_BITS = log2(10**10)

SHORTEST, LONGEST = 3, 24  # letters of a word
SEGMENT = 2.0  # bits that say of which kind the next segment is
PERIODS = 24  # a repeat says how far back it starts, then goes on for AGAIN bits a character
AGAIN = 0.25
STRAIGHT, TURN = 0.5, log2(6)  # a step of a walk goes on or takes one of six ways
DATE, YEAR = log2(366 * 200 * 4), log2(200)
LEET = 1.0  # each sign that stands for a letter
DATES = ((re.compile(r"(?:19|20)\d\d([-./_]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.A), DATE),
         (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-./_]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", re.A), DATE),
         (re.compile(r"(?:0[1-9]|1[0-2])([-./_]?)(?:0[1-9]|[12]\d|3[01])\1(?:19|20)\d\d", re.A), DATE),
         (re.compile(r"(?:19|20)\d\d", re.A), YEAR))
#: Signs for letters; 1 stands for two of them.
SIGNS = [str.maketrans("4@38610!5$7+2", "aaebgl" + "oi" + "sst" + "tz"), str.maketrans("4@38610!5$7+2", "aaebgi" + "oi" + "sst" + "tz")]

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
_INDENT = (0, 1.5, 1.75, 2.25)
_PLACE = {c: (x + dx, y) for rows in (_ROWS, _SHIFTED) for y, (row, dx) in enumerate(zip(rows, _INDENT)) for x, c in enumerate(row)}
WALK = log2(len(_PLACE) // 2)  # the first key


@cache
def step(a: str, b: str) -> tuple[float, int] | None:
    """The direction from a key to one beside it, or None."""
    if a not in _PLACE or b not in _PLACE:
        return None
    (x, y), (u, v) = _PLACE[a], _PLACE[b]
    return (u - x, v - y) if 0 < abs(u - x) + abs(v - y) and abs(u - x) <= 1 and abs(v - y) <= 1 else None


def character_bits(c: str) -> float:
    return log2(10 if "0" <= c <= "9" else 26 if "a" <= c.lower() <= "z" else 33 if c.isascii() else 128)


def case_bits(word: str) -> float:
    """First letter, all or none in upper case are one choice; other ways say each letter's case."""
    upper = [c.isupper() for c in word]
    if not any(upper):
        return 0.0
    return 1.0 if all(upper) or not any(upper[1:]) else float(len(word))


def lowered(value: str) -> str:
    """Lower case, character by character, so that positions stay."""
    return value.lower() if value.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in value)


def word_bits(value: str, words: dict[str, float]) -> float:
    """What one word costs, as it is written; infinite if it is none."""
    lower = lowered(value)
    best = words.get(lower, inf)
    if not value.isalpha():
        for signs in SIGNS:
            plain = lower.translate(signs)
            if plain in words:
                best = min(best, words[plain] + LEET * sum(a != b for a, b in zip(lower, plain)))
    return best + case_bits(value)


def guess_bits(value: str, words: dict[str, float], enough: float = inf) -> float:
    """Bits of the cheapest segmentation; any number of at least ``enough`` once none can be cheaper than that."""
    n = len(value)
    done = [inf] * (n + 1)  # cheapest way to say the first j characters, ended
    done[0] = 0.0
    brute = one = more = inf  # ways that are inside a segment: by brute force, on a walk's first key, on a walk
    again = [inf] * (PERIODS + 1)
    lower = lowered(value)
    read = [lower] if value.isalpha() else [lower, *(lower.translate(signs) for signs in SIGNS)]
    for j, c in enumerate(value):
        start = done[j] + SEGMENT
        if start < enough:
            for size in range(SHORTEST, min(LONGEST, n - j) + 1):
                if any(r[j : j + size] in words for r in read):
                    done[j + size] = min(done[j + size], start + word_bits(value[j : j + size], words))
            if c.isdigit():
                for pattern, bits in DATES:
                    found = pattern.match(value, j)
                    if found:
                        done[found.end()] = min(done[found.end()], start + bits)
        brute = min(brute, start) + character_bits(c)
        way = step(value[j - 1], c) if j else None
        if way is None:
            more = inf
        else:
            more = min(one + TURN, more + (STRAIGHT if j > 1 and step(value[j - 2], value[j - 1]) == way else TURN))
        one = start + WALK if c in _PLACE else inf
        for p in range(1, min(PERIODS, j) + 1):
            again[p] = min(again[p], start + log2(PERIODS)) + AGAIN if c == value[j - p] else inf
        done[j + 1] = min(done[j + 1], brute, more, *again)
        if enough < inf and min(brute, one, more, *again, *done[j + 1 : j + 1 + LONGEST]) >= enough:
            return enough
    return done[n]


def values(text: str):
    """(start, end) of the values in a credential's place that aren't just letters of one case, as prose is."""
    for m in PLACES.finditer(text):
        group = 1 if m[1] is not None else 2
        value = m[group].rstrip(AROUND)
        classes = {("digit" if c.isdigit() else "upper" if c.isupper() else "letter" if c.isalpha() else "sign") for c in value}
        if len(value) >= 6 and len(classes) > 1:
            yield m.start(group), m.start(group) + len(value)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed forms, leftmost and without overlap per form, long enough."""
    return [(kind, *m.span()) for kind, form, group, least in FORMS for m in form.finditer(text) if len(m[group]) >= least]


_ANY_HEX = re.compile(rb"[0-9a-f]{16}")


def found_in(data: bytes, words: dict[str, float], least_bits: float) -> tuple[list, list, int, int]:
    """Base spans, added spans, number of values in a credential's place, number of those that cost ``least_bits``."""
    lower = data.lower()
    placed = any(h in lower for h in HINTS)
    if not (placed or any(h in lower for h in ASSIGN_HINTS) or b"AKIA" in data or _ANY_HEX.search(data)):
        return [], [], 0, 0
    text = data.decode("utf-8", "replace")
    base, added, n, strong = base_spans(text), [], 0, 0
    if placed:
        covers = sorted((s, e) for _, s, e in base)
        i, reach = 0, 0
        for start, end in values(text):
            n += 1
            while i < len(covers) and covers[i][0] <= start:
                reach, i = max(reach, covers[i][1]), i + 1
            if guess_bits(text[start:end], words, least_bits) >= least_bits:
                strong += 1
                if reach < end:
                    added.append(("guess", start, end))
    return base, added, n, strong


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, values in a credential's place left out; words of ``SHORTEST`` to ``LONGEST`` letters."""
    def run(batches):
        seen: Counter = Counter()

        def passed_on():
            merged: Counter = Counter()
            for term, n in seen.items():
                word = lowered(term.decode("utf-8", "replace"))
                if SHORTEST <= len(word) <= LONGEST:
                    merged[word] += n
            return pa.RecordBatch.from_arrays([pa.array(merged, pa.string()), pa.array(merged.values(), pa.int64())], names=["word", "n"])

        for part in slices(batches, 0):
            for data in part.column(0).to_pylist():
                data = data or b""
                if any(h in data.lower() for h in HINTS):
                    text, at, kept = data.decode("utf-8", "replace"), 0, []
                    for start, end in values(text):
                        kept.append(text[at:start])
                        at = end
                    data = " ".join([*kept, text[at:]]).encode()
                for terms in term_lists(data):
                    seen.update(terms)
            if len(seen) >= 100_000:
                yield passed_on()
                seen.clear()
        yield passed_on()

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> dict[str, float]:
    """Bits per word: at most ``ONE_IN`` words, as each makes up at least that share of all occurrences."""
    counted = stored(word_counts(docs), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {r.word: log2(total / r.n) for r in counted.where(F.col("n") * ONE_IN >= total).collect()}


SPAN = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """(doc_id, base, added, n_values, n_strong): spans in code points, ends exclusive, by start and then kind as in ``KINDS``.

    A span of kind assign is the whole match, name and sign included; one of kind guess is the value alone. ``n_values``
    counts the values in a credential's place, ``n_strong`` those that cost ``least_bits``, also where a fixed form covers them."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary(docs))
    order = {k: i for i, k in enumerate(KINDS)}
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    structs = lambda rows: [dict(zip(("kind", "start", "end"), r)) for r in sorted(rows, key=lambda r: (r[1], order[r[0]]))]

    def run(batches):
        for part in slices(batches, 1):
            found = [found_in(t or b"", words.value, least_bits) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([structs(f[0]) for f in found], spans), pa.array([structs(f[1]) for f in found], spans),
                                              *(pa.array([f[i] for f in found], pa.int64()) for i in (2, 3))], names=["doc_id", "base", "added", "n_values", "n_strong"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {SPAN}, added {SPAN}, n_values long, n_strong long")
