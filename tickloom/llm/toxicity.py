"""Toxicity by a noisy channel: restore disguised words, then score what they say.

A writer who hides a word swaps letters for look-alikes (1d10t, or letters of another script), spaces it out
(i d i o t, i.d.i.o.t) or repeats letters (idiiot, iiddiioott). Such a token becomes a lattice of the letters each character may stand for; Viterbi finds
the likeliest letters under a trigram model of characters, counted over the words of all documents. Lattices that no
path takes to an entry of the lexicon aren't decoded, as nothing could come of them. The restored words are looked up in a lexicon learnt from labelled rows: words whose texts are mostly toxic, beyond chance, and
stems, that is, beginnings that several words of a text must share (a language may build insults on a stem, each word
too rare to be learnt by itself). The score is 1 - (1 - p0) * product(1 - p_entry) over the lexicon entries a text
holds, with p_entry the share of toxic texts among labelled texts with the entry.

Nulls and empty texts score p0. Labels that repeat a doc_id count once, the highest wins; null labels are left out.
Every row is scored by itself, so repeated rows agree; an empty table gives none. Without toxic labels the lexicon
is empty and every text scores p0.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import carrying, held_out, slices, stored

#: Labelled rows the lexicon is learnt from, at most; the first by a hash of the id.
TRAIN_ROWS = 20_000
#: Words and stems that a lexicon is chosen from, at most: those in most toxic texts.
CANDIDATES = 4096
MIN_SUPPORT, MIN_PRECISION = 3, 0.85
#: Letters of a stem, and how many words of a text must begin with it.
STEM, REPEATS = range(3, 11), (2, 3)
#: Log-likelihood that a word's gain must have beyond the logarithm of the number of words tried.
CERTAINTY = 3
#: Share of disguised words that the channel takes to be lexicon words, whatever their share of the corpus.
LEXICON_SHARE = 0.1

#: Steps of Viterbi with more transitions than this are done as arrays, with the same result.
DENSE = 2048

#: Letters of the model: a-z and the letters of Latin-1, then "other" and the word's edge. Bounds the trigram table.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
INDEX = {c: i for i, c in enumerate(LETTERS)}
OTHER, EDGE = len(LETTERS), len(LETTERS) + 1
SIZE = len(LETTERS) + 2

#: Letters that a character is known to stand in for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
LOOK_ALIKES |= zip("авеікмнпорстухѕјһԁɡɩ" "αβεικνορτυχγη", "abeikmhnopctyxsjhdgi" "abeikvoptuxyn")
SEPARATORS = ".-_·'’~^:,;/\\"
WILD = "*#"

_RUN = re.compile(r"(.)\1\1")
_DOUBLED = re.compile(r"(.)\1")
_RUNS = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_TAIL, _HEAD = " .,;:!?…*#%&$)]}\"'»”’", "\"'([{«“‘"


def core(token: str) -> str:
    """``token`` without the punctuation around it."""
    return token.rstrip(_TAIL).lstrip(_HEAD)


def suspicious(word: str) -> bool:
    return not word.isalpha() or _RUN.search(word) is not None


@lru_cache(maxsize=65536)
def stands_for(c: str) -> str:
    """Letters that a character which is none of the model's may stand for: look-alikes, other forms, added marks."""
    if c in INDEX:
        return ""
    plain = unicodedata.normalize("NFKD", c)[:1].lower()
    return LOOK_ALIKES.get(c) or LOOK_ALIKES.get(plain) or (plain if plain in INDEX else "")


def mixed(word: str) -> bool:
    """Whether letters of another script or form stand among letters of the model, or all are forms of them."""
    odd = [c for c in word if c not in INDEX and c.isalpha()]
    return any(map(stands_for, odd)) and (len(odd) < len(word) or any(unicodedata.normalize("NFKD", c)[:1].lower() in INDEX for c in odd))


def entries(words: list[str]) -> set[str]:
    """What a lexicon may hold of a text's plain words: each word, and "stem+n" where n or more words share a stem."""
    shared = Counter(w[:k] for w in words for k in STEM if k < len(w))
    return set(words).union(f"{p}+{n}" for p, found in shared.items() for n in REPEATS if found >= n)


def letter_counts(docs: DataFrame) -> DataFrame:
    """(code, n): trigrams of the letters of all words of all texts; code = (first * SIZE + second) * SIZE + third."""
    def run(batches):
        words, grams = Counter(), Counter()
        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                words.update((t or "").lower().split())
                if len(words) > 200_000:
                    _trigrams(words, grams)
                    words.clear()
        _trigrams(words, grams)
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _trigrams(words: Counter, grams: Counter) -> None:
    get = INDEX.get
    for token, n in words.items():
        w = core(token)
        if w and not suspicious(w):
            a, b = EDGE, EDGE
            for c in w:
                k = get(c, OTHER)
                grams[(a * SIZE + b) * SIZE + k] += n
                a, b = b, k
            grams[(a * SIZE + b) * SIZE + EDGE] += n


def _trie(words) -> tuple[list[dict[int, int]], list[int], set[int]]:
    """(children by letter, own letter, ends) of the nodes; the root is 0. Words with letters outside the model, which
    are never restored, are left out."""
    kids, last, ends = [{}], [-1], set()
    for w in words:
        if all(c in INDEX for c in w):
            at = 0
            for k in map(INDEX.get, w):
                if k not in kids[at]:
                    kids[at][k] = len(kids)
                    kids.append({})
                    last.append(k)
                at = kids[at][k]
            ends.add(at)
    return kids, last, ends


class Restorer:
    """Viterbi decoder of character lattices; its table has SIZE^3 entries."""

    def __init__(self, counts: dict[int, int], lexicon: dict[str, float]):
        n3 = np.zeros((SIZE, SIZE, SIZE))
        for code, n in counts.items():
            n3.flat[code] = n
        total = n3.sum()
        words = [w for w in lexicon if "+" not in w]
        if words:
            own = Counter()
            _trigrams(Counter(dict.fromkeys(words, 1)), own)
            scale = LEXICON_SHARE * max(total, 1.0) / sum(own.values())
            for code, n in own.items():
                n3.flat[code] += n * scale
        n2, n1 = n3.sum(axis=2), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1 + 1).sum()
        m2 = n3.sum(axis=0)
        p2 = (m2 + 5 * p1[None, :]) / (m2.sum(axis=1, keepdims=True) + 5)
        self.logp = np.log((n3 + 5 * p2[None, :, :]) / (n2[:, :, None] + 5)).astype(np.float32)
        self.lexicon = dict(lexicon)
        self.stems = {p: int(n) for p, _, n in (w.partition("+") for w in lexicon) if n}
        # looked up with repetitions taken out, as the channel can't tell an added letter from a doubled one
        self.plain = {_RUNS.sub(r"\1", w): w for w in sorted(words)}
        self.lengths = sorted({len(w) for w in self.plain})
        self.tries = _trie(self.plain), _trie(self.stems)
        self.cache: dict[str, tuple[str, ...]] = {}

    def lattice(self, word: str) -> list[list[tuple[int | None, float]]]:
        """For each character the letters it may be, with the channel's log-probability; None: nothing."""
        out, before = [], ""
        for c in word:
            if c in INDEX:
                own = [(INDEX[c], -0.05)]
            elif letters := stands_for(c):
                own = [(INDEX[x], -0.7) for x in letters] + [(OTHER, -6.0)]
            elif c in WILD:
                own = [(None, -1.0)] + [(k, -4.0) for k in range(len(LETTERS))]
            elif c in SEPARATORS or c.isspace():
                own = [(None, -0.05)]
            else:
                own = [(OTHER, -0.1)]
            if c == before:
                own = [*own, (None, -0.5)]
            out.append(own)
            before = c
        return out

    def decode(self, word: str) -> str:
        """The letters of the best path: exact, over all states of two letters, SIZE^2 at most."""
        logp = self.logp
        states: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
        for own in self.lattice(word):
            if len(states) * len(own) > DENSE:
                states = self._step(states, own)
                continue
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (s, path) in states.items():
                for k, cost in own:
                    if k is None:
                        key, score, way = (a, b), s + cost, path
                    else:
                        key, score, way = (b, k), s + cost + float(logp[a, b, k]), (path, k)
                    if key not in new or score > new[key][0]:
                        new[key] = (score, way)
            states = new
        _, path = max(((s + float(logp[a, b, EDGE]), way) for (a, b), (s, way) in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            path, k = path
            letters.append(LETTERS[k] if k < OTHER else "?")
        return "".join(reversed(letters))

    def _step(self, states: dict[tuple[int, int], tuple[float, tuple]], own: list[tuple[int | None, float]]) -> dict[tuple[int, int], tuple[float, tuple]]:
        """A step of ``decode`` for many states at once."""
        now, costs = np.full((SIZE, SIZE), -np.inf), np.full(SIZE, -np.inf)
        for at, (s, _) in states.items():
            now[at] = s
        for k, cost in own:
            if k is not None:
                costs[k] = max(costs[k], cost)
        scores = now[:, :, None] + self.logp
        first = scores.argmax(axis=0)
        best = np.take_along_axis(scores, first[None], axis=0)[0] + costs
        skip = max((cost for k, cost in own if k is None), default=-np.inf)
        new = {at: (s + skip, path) for at, (s, path) in states.items()} if skip > -np.inf else {}
        for b, k in np.argwhere(best > -np.inf).tolist():
            if (b, k) not in new or best[b, k] > new[b, k][0]:
                new[b, k] = (float(best[b, k]), (states[int(first[b, k]), b][1], k))
        return new

    def possible(self, word: str, anywhere: bool = False) -> bool:
        """Whether a path of the lattice of ``word`` spells a word or begins with a stem; ``anywhere``: or holds one."""
        own = [({k for k, _ in x if k is not None}, any(k is None for k, _ in x)) for x in self.lattice(word)]
        for stems, (kids, last, ends) in enumerate(self.tries):
            now = {0}
            for letters, nothing in own:
                new = set(now) if nothing else set()
                for at in now:
                    new.update(to for k, to in kids[at].items() if k in letters)
                    if not stems and last[at] in letters:  # a repetition, which is taken out before the look-up
                        new.add(at)
                if (stems or anywhere) and not ends.isdisjoint(new):
                    return True
                if anywhere:
                    new.add(0)
                if not (now := new):
                    break
            if not stems and not ends.isdisjoint(now):
                return True
        return False

    def _stems(self, word: str) -> tuple[str, ...]:
        return tuple(f"{p}+" for k in STEM if k < len(word) and (p := word[:k]) in self.stems)

    def found(self, token: str) -> tuple[str, ...]:
        """Lexicon words that a token holds, and stems, marked by a plus sign, that it begins with."""
        if (got := self.cache.get(token)) is None:
            w = core(token)
            got = (w,) if w in self.lexicon else ()
            odd = suspicious(w)
            if w and not odd:
                got += self._stems(w)
            doubled = _DOUBLED.search(w) is not None
            if doubled and not got and w.isalpha() and (r := _RUNS.sub(r"\1", w)) in self.plain:
                got = (self.plain[r],)  # decoding adds no letter and takes only repetitions out
            elif w and not got and (odd or doubled or not w.isascii() and mixed(w)):
                for form in dict.fromkeys((w, token.strip(".,;:?…\"'«»“”‘’[]{}"))):
                    if self.possible(form):
                        r = _RUNS.sub(r"\1", restored := self.decode(form))
                        if got := (*([self.plain[r]] if r in self.plain else ()), *self._stems(restored)):
                            break
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def hits(self, text: str) -> set[str]:
        low = text.lower()
        out, stems = set(), Counter()
        for t, n in Counter(low.split()).items():
            for w in self.found(t):
                if w.endswith("+"):
                    stems[w[:-1]] += n
                else:
                    out.add(w)
        for m in _SPACED.finditer(low):  # letters set apart: the words may start and end anywhere in the run
            if not self.possible(apart := "".join(m[0].split()), anywhere=True):
                continue
            run = _RUNS.sub(r"\1", restored := self.decode(apart))
            for n in self.lengths:  # one or two letters would be met by chance within a run
                out.update(self.plain[w] for i in range(len(run) - n + 1) if (w := run[i : i + n]) in self.plain and (n > 2 or n == len(run)))
            for p in self.stems:
                stems[p] += restored[:-1].count(p)
        out.update(f"{p}+{self.stems[p]}" for p, n in stems.items() if n >= self.stems[p])
        return out

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}


def _training_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(family, toxic, words): the ``entries`` of labelled texts, held-out rows left out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)

    def run(batches):
        for b in slices(batches, 0):
            lists = [(x or "").lower().split() for x in b.column(0).to_pylist()]
            words = [sorted(entries([w for t in x if (w := core(t)) and not suspicious(w)])) for x in lists]
            family = [min((zlib.crc32(" ".join(x[i : i + 4]).encode()) for i in range(max(1, len(x) - 3))), default=0) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(family, pa.int64()), b.column(1), pa.array(words, pa.list_(pa.string()))], names=["family", "toxic", "words"])

    # TRAIN_ROWS rows of two numbers at most: the broadcast is bounded
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    return own.mapInArrow(run, "family long, toxic int, words array<string>")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """(lexicon with its entries' probabilities, p0), from at most TRAIN_ROWS labelled rows.

    Near copies mostly share the least hash of their four-word runs and count as one family. A word is taken if, by families, most
    texts with it are toxic, and so many more than of all texts that none of all the words would be so by chance. Of a stem and the words and stems that continue it, the one with the greatest
    gain in likelihood is taken: a word met by chance says nothing where only its stem's repetition does.
    """
    rows = stored(_training_words(docs, labels), "words")
    by_word = rows.select("family", "toxic", F.explode("words").alias("word")).groupBy("word", "family").agg(F.max("toxic").alias("t")) \
        .groupBy("word").agg(F.sum("t").alias("t"), F.sum(1 - F.col("t")).alias("c"))
    by_word = stored(by_word, "counts")
    of = rows.groupBy("family").agg(F.max("toxic").alias("t")).agg(F.coalesce(F.sum("t"), F.lit(0)), F.count("*")).first()
    base, vocabulary = (of[0] + 0.5) / (of[1] + 1), by_word.count()
    counts = by_word.where((F.col("t") >= MIN_SUPPORT) & (F.col("t") >= MIN_PRECISION * (F.col("t") + F.col("c")))).orderBy(F.desc("t"), "c", "word").limit(CANDIDATES)
    sure = []
    for r in counts.collect():
        t, c = r.t, r.c
        gain = t * math.log(t / (t + c) / base) + (c * math.log(c / (t + c) / (1 - base)) if c else 0)
        if gain >= math.log(vocabulary) + CERTAINTY:
            sure.append((-gain, -len(r.word), r.word, (t + 0.5) / (t + c + 1)))
    lexicon = {}
    for _, _, word, p in sorted(sure):
        if not any(_related(word, other) for other in lexicon):
            lexicon[word] = p
    without = rows if not lexicon else rows.where(~F.arrays_overlap("words", F.array(*map(F.lit, sorted(lexicon)))))
    rest = without.groupBy("family").agg(F.max("toxic").alias("t")).agg(F.coalesce(F.sum("t"), F.lit(0)), F.count("*")).first()
    return lexicon, (rest[0] + 0.5) / (rest[1] + 1)


def _related(a: str, b: str) -> bool:
    """Whether one entry is a stem that the other one continues or is."""
    (p, _, m), (q, _, n) = a.partition("+"), b.partition("+")
    return bool(m or n) and (p.startswith(q) or q.startswith(p))


def fit(docs: DataFrame, labels: DataFrame):
    """Broadcast (Restorer, p0): the lexicon from labels, the character model from all of ``docs``."""
    lexicon, p0 = learn(docs, labels)
    counts = {r.code: r.n for r in letter_counts(docs).collect()}  # SIZE^3 rows at most, whatever the corpus
    return docs.sparkSession.sparkContext.broadcast((Restorer(counts, lexicon), p0))


def with_score(docs: DataFrame, model, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``: the toxicity of ``text``, 0 to 1; a column of that name is replaced."""
    rest = [c for c in docs.columns if c != into]

    def run(batches):
        restorer, p0 = model.value
        for b in slices(batches, "text"):
            scores = []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                miss = 1 - p0
                for w in restorer.hits(t) if t else ():
                    miss *= 1 - restorer.lexicon[w]
                scores.append(1 - miss)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(scores, pa.float64())], names=[*rest, into])

    return docs.select(*rest).mapInArrow(run, docs.select(*rest).withColumn(into, F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from 0.5)."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@carrying("doc_id", "text")
def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    into = "_toxicity"
    return with_score(docs, fit(docs, labels), into).where(F.col(into) < 0.5).select(*docs.columns)
