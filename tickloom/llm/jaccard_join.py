"""Self-join of documents by Jaccard similarity of their word shingles, exact at any threshold.

Candidates come from a partition-signature join: the hashes of a set's shingles are dealt over bands, a leaf is a digest
of what one band holds, and two documents meet when they agree in one band. At similarity t two sets of sizes a <= b
differ in at most a * (1 - t) / t shingles, so with more bands than that they agree in at least one: no pair is
lost. Shingles are also hashed into groups: a document's group counts are a point, and the sum of coordinate minima of
two points bounds the overlap of their sets from above, which rules most pairs of a leaf out before their sets are
compared. (Boxes over the points don't serve to find candidates: see the README.)

A large leaf is not paired out. Its members are first verified against its centre, the one that meets most others; what
these links join into one component needs no further check. Only where members of a centre's leaves still lie in
different components are they compared with each other, block against block, with their sets at hand: each task joins components as it finds links, so at most one
link a member leaves a pair of blocks, and blocks are cut by bytes.

Sets that are equal form a class, so copies cost one row each. A document of fewer words than a shingle has its whole
sequence as its one shingle; without words (or with a null text) it has none and links with nothing. Rows that repeat
a doc_id with another text are documents of their own; rows that repeat both are in one class.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import HOT_SHARE, attach, carrying, components, gather, row_key, slices, stored

GROUPS = 128
#: Bytes of a group's sets and points that a task holds as one block.
BLOCK_BYTES = 8 << 20
#: Members verified in one stream against one copy of their centre.
PER_CENTRE = 256
#: Uses of a set that one copy of it serves.
PER_SET = 1_024

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


@dataclass(frozen=True)
class Join:
    """Words a shingle, and the threshold as a ratio of whole numbers: num * union <= den * intersection."""

    words: int = 5
    num: int = 4
    den: int = 5

    def linked(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)

    def differ(self, below: int) -> int:
        """Most shingles in which two linked sets can differ, the smaller one of size < ``below``."""
        return (below - 1) * (self.den - self.num) // self.num


class Leaves:
    """Size classes and their numbers of bands; grows with the largest set met."""

    def __init__(self, join: Join):
        self.join, self.ends, self.bands, self.spare = join, [1], [], []

    def of(self, n: int) -> list[int]:
        """Size classes in which a set of n shingles has leaves: of two linked sets, the larger one is in the
        smaller one's class or the next."""
        j = self.join
        while self.ends[-1] <= n:
            lo, end = self.ends[-1], -(-(self.ends[-1] * j.den) // j.num) + 1
            d = j.differ(end)
            m = d + 1
            # more bands, so that two sets agree in some band that isn't merely empty in both
            while 0 < d and m < 4 * d and m - d - 1 < (e := m * math.exp(-lo / m)) + 2 * math.sqrt(e):
                m += 1
            self.ends.append(end)
            self.bands.append(m)
            self.spare.append(m - d - 1)
        k = bisect.bisect_right(self.ends, n) - 1
        below = k > 0 and (self.ends[k] - 1) * j.den >= n * j.num
        return [k - 1, k] if below else [k]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL[3]
    h = (h ^ (h >> np.uint64(29))) * _MUL[4]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; words split at white space, A-Z lower-cased."""
    lists = [(t or b"").lower().split() for t in texts]
    sizes = [len(x) for x in lists]
    flat = np.empty(sum(sizes), dtype=object)
    flat[:] = [w for x in lists for w in x]
    codes, uniques = pd.factorize(flat)
    hashed = pd.util.hash_array(uniques, categorize=False)[codes] if len(flat) else np.empty(0, dtype=np.uint64)
    out, at = [], 0
    for n in sizes:
        own = hashed[at : at + n]
        at += n
        if n == 0:
            out.append(own)
        elif n < words:
            acc = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in own:
                    acc = (acc ^ h) * _MUL[0]
                out.append(_mix(np.array([acc])))
        else:
            acc = np.zeros(n - words + 1, dtype=np.uint64)
            for k in range(words):
                acc = (acc ^ own[k : n - words + 1 + k]) * _MUL[0]
                acc ^= acc >> np.uint64(29)
            out.append(np.unique(_mix(acc)))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def point(s: np.ndarray) -> np.ndarray:
    """Number of the set's shingles in each group."""
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def leaf_keys(s: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Keys of a set's leaves, one a band of each of its size classes.

    A key digests which of the band's finest groups (single hashes) hold a shingle, so equal contents have equal
    keys. Two linked sets agree in more than ``spare`` bands; a set with no more empty bands than that leaves the
    empty ones out, and still meets any partner in another.
    """
    keys, mixed = [], _mix(s)
    hi, lo = (mixed >> np.uint64(38)).astype(np.float64), (mixed & np.uint64(0x3FFFFFF)).astype(np.float64)
    for k in leaves.of(len(s)):
        m = leaves.bands[k]
        band = ((s >> np.uint64(8)) % np.uint64(m)).astype(np.int64)
        a, b = np.bincount(band, hi, m).astype(np.uint64), np.bincount(band, lo, m).astype(np.uint64)
        tag = np.full(m, k + 1, dtype=np.uint64) * _MUL[1] + np.arange(m, dtype=np.uint64) * _MUL[2]
        key = _mix(a * _MUL[0] + _mix(b ^ tag))
        full = np.bincount(band, minlength=m) > 0
        keys.append(key[full] if m - full.sum() <= leaves.spare[k] else key)
    return np.concatenate(keys).view(np.int64)


def sketches(docs: DataFrame, join: Join) -> DataFrame:
    """Per document: doc_id, n_shingles, digest and node (null without shingles), point, text_key (a hash of the
    text that tells rows of one id apart), and _row if ``docs`` has it.
    """
    def run(batches):
        for b in slices(batches, 1):
            sets = shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), join.words)
            digests = [_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([d if d is None else _node(d) for d in digests], pa.int64()),
                pa.array([point(s).astype("<i4").tobytes() if len(s) else None for s in sets], pa.binary()),
                *b.columns[2:],
            ], names=["doc_id", "n_shingles", "digest", "node", "point", *more])

    more = ["text_key", *(c for c in ("_row",) if c in docs.columns)]
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.withColumn("text_key", F.xxhash64("text")).select("doc_id", "text", *more)
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, node long, point binary, text_key long" + ", _row binary" * (len(more) - 1))


def leaf_rows(docs: DataFrame, join: Join) -> DataFrame:
    """(node, leaf) of all sets, for the shuffle by leaf. Texts are split once more for it: stored, the leaves would be
    as large as the texts. They are given once for each set that a task meets, so copies, however many, fill no leaf.
    """
    def run(batches):
        leaves, seen = Leaves(join), set()
        for b in slices(batches, 0):
            nodes, keys = [], []
            for s in shingle_sets(b.column(0).cast(pa.binary()).to_pylist(), join.words):
                if len(s) and (node := _node(_digest(s))) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    keys.append(leaf_keys(s, leaves))
            if nodes:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])), pa.array(np.concatenate(keys))], names=["node", "leaf"])

    return docs.select("text").mapInArrow(run, "node long, leaf long")


def _bounded(pairs: DataFrame, points: DataFrame, join: Join) -> DataFrame:
    """``pairs`` (a, b) whose sizes and points leave the threshold in reach."""
    def run(batches):
        for t in batches:
            na, nb = t.column(2).to_numpy(), t.column(4).to_numpy()
            if not len(na):
                continue
            p = np.frombuffer(b"".join(t.column(3).to_pylist()), "<i4").reshape(-1, GROUPS)
            q = np.frombuffer(b"".join(t.column(5).to_pylist()), "<i4").reshape(-1, GROUPS)
            most = np.minimum(p, q).sum(axis=1, dtype=np.int64)
            ok = pa.array(join.den * most >= join.num * (na + nb - most))
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], names=["a", "b"])

    p = points.select("node", "n_shingles", "point")
    counts = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    left = stored(_side(p, "a").join(counts, "a"), "left")
    both = attach(pairs, left, "a", "partners").join(_side(p, "b"), "b")
    return both.select("a", "b", "a_n", "a_point", "b_n", "b_point").mapInArrow(run, "a long, b long")


def _side(points: DataFrame, side: str) -> DataFrame:
    return points.select(F.col("node").alias(side), F.col("n_shingles").alias(f"{side}_n"), F.col("point").alias(f"{side}_point"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, text_key, ...) with the text of the rows it names."""
    named = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    return named.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))


def _with_sets(uses: DataFrame, sets: DataFrame) -> DataFrame:
    """``uses`` (node, ...) with each node's set; both are shuffled once. Nodes of more than HOT_SHARE of all uses, which are
    at most 1 / HOT_SHARE, are dealt over chunks of about PER_SET uses, each of which their set goes to once. Only the
    counts of these nodes are broadcast, no set is."""
    counts = stored(uses.groupBy("node").agg(F.count("*").alias("uses")), "uses")
    total = counts.agg(F.sum("uses")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("uses") > max(PER_SET, int(total * HOT_SHARE))).select("node", F.ceil(F.col("uses") / F.lit(PER_SET)).cast("int").alias("chunks")))
    chunks = F.coalesce("chunks", F.lit(1))
    left = uses.join(hot, "node", "left").withColumn("chunk", F.pmod(F.xxhash64(*uses.columns), chunks).cast("int")).drop("chunks")
    right = sets.join(hot, "node", "left").select("node", "set", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    return left.join(right.hint("merge"), ["node", "chunk"]).drop("chunk")


def verified(sets: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """``pairs`` (centre, member) that are linked. ``sets``: node and set of each class that a pair names.

    Each centre's members are dealt over parts of about PER_CENTRE; its set goes to each part once, first.
    """
    pairs = stored(pairs.select("centre", "member"), "pairs")
    counts = stored(pairs.groupBy("centre").agg(F.count("*").alias("members")), "centres")
    parts = F.ceil(F.col("members") / F.lit(PER_CENTRE)).cast("int")
    as_member = attach(pairs, counts, "centre", "members") \
        .select(F.col("member").alias("node"), "centre", F.pmod(F.xxhash64("member"), parts).cast("int").alias("part"), F.lit(1).alias("after"))
    as_centre = counts.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("after"))
    uses = stored(as_member.unionByName(as_centre), "dealt")
    rows = _with_sets(uses, sets).select("centre", "part", "after", "node", "set") \
        .repartition("centre", "part").sortWithinPartitions("centre", "part", "after")

    def run(batches):
        key, centre = None, np.empty(0, dtype=np.uint64)
        for t in slices(batches, 4):
            found = []
            for c, p, after, node, data in zip(*(t.column(i).to_pylist() for i in range(5))):
                s = np.frombuffer(data, "<u8")
                if not after:
                    key, centre = (c, p), s
                elif key == (c, p) and join.linked(len(np.intersect1d(centre, s, assume_unique=True)), len(centre), len(s)):
                    found.append((c, node))
            yield _pairs(found)

    return rows.mapInArrow(run, "a long, b long").distinct()


def link_classes(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """(sketches, components): all documents' sketches, and (node, component) of the classes that have links."""
    all_docs = stored(sketches(docs, join), "sketches")
    rows = all_docs.where("node IS NOT NULL")
    # one document lends each class its text
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("doc_id", "digest", "text_key")).alias("x")).select("node", "x.*"), "nodes")
    leaves = leaf_rows(docs, join)
    leaf = Window.partitionBy("leaf")
    shared = stored(leaves.withColumns({"least": F.min("node").over(leaf), "most": F.max("node").over(leaf)})
                    .where("least <> most").select("leaf", "node").distinct(), "leaves")
    weights = shared.groupBy("node").agg(F.count("*").alias("met"))
    points = rows.select("node", "n_shingles", "point").dropDuplicates(["node"]).join(weights, "node").select("node", "n_shingles", "point", "met")
    points = stored(points, "points")
    # sets of the classes that share a leaf, once each
    sets = stored(_sets(docs, points.select("node").join(nodes, "node"), join), "sets")

    # the member that meets most others is the likeliest to be linked with many
    best = F.max(F.struct("met", "node")).over(leaf)["node"]
    stars = attach(shared, points.select("node", "n_shingles", "met", F.col("met").alias("uses")), "node", "uses").withColumn("centre", best).select("leaf", "node", "centre", "n_shingles")
    stars = stored(stars, "stars")
    pairs = stars.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(verified(sets, _bounded(pairs, points, join).toDF("centre", "member"), join), "links")
    done = stored(components(first), "done")

    # the leaves of a centre together, where their members are not all joined yet: compare those that lie apart
    met = stars.select("centre", "node", "n_shingles").distinct()
    named = met.join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = F.sum(8 * F.col("n_shingles") + 4 * GROUPS)
    apart = named.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"), size.alias("bytes")).where("x <> y AND members > 2")
    blocks = F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES)).cast("int").alias("blocks")
    open_ = stored(named.join(apart.select("centre", blocks), "centre"), "open")
    if open_.isEmpty():
        return all_docs, done
    second = stored(_apart(sets, open_, join), "links")
    return all_docs, done if second.isEmpty() else components(first.unionByName(second))


def _sets(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(node, set) of the classes ``wanted``: node, doc_id, digest, text_key. A set is its sorted hashes."""
    def run(batches):
        for t in slices(batches, 2):
            sets = shingle_sets(t.column(2).cast(pa.binary()).to_pylist(), join.words)
            own = [(n, s.astype("<u8").tobytes()) for n, d, s in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), sets) if _digest(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], names=["node", "set"])

    return _texts_of(docs, wanted).select("node", "digest", "text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


class _Block:
    """Members of a centre's group that wait in a task, and the components that its links have joined so far."""

    def __init__(self, join: Join, centre: int):
        self.join, self.centre, self.members, self.root, self.ids = join, centre, [], {}, None

    def add(self, node: int, component: int, s: np.ndarray) -> None:
        self.members.append((node, component, s, point(s)))

    def _close(self) -> None:
        self.ids, self.comps = (np.array([m[i] for m in self.members], np.int64) for i in (0, 1))
        self.lens = np.array([len(m[2]) for m in self.members], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat, self.points = np.concatenate([m[2] for m in self.members]), np.stack([m[3] for m in self.members])
        self.members = []

    def links(self, node: int, component: int, s: np.ndarray, ahead: int | None = None) -> list[tuple[int, int]]:
        """Links that join ``node``'s component with those of members, of the first ``ahead`` ones if given. The centre has
        been compared with all members before."""
        if self.ids is None:
            self._close()
        while component in self.root:
            component = self.root[component]
        look = np.flatnonzero((self.comps[:ahead] != component) & (self.ids[:ahead] != self.centre)) if node != self.centre else ()
        if not len(look):
            return []
        den, num, n = self.join.den, self.join.num, len(s)
        most = np.minimum(self.points[look], point(s)).sum(axis=1, dtype=np.int64)
        look = look[den * most >= num * (self.lens[look] + n - most)]
        found = []
        while len(look):
            # a few at a time: a link spares the rest of its component
            some, look = look[:64], look[64:]
            theirs = self.flat[gather(self.starts[some], self.lens[some])]
            hit = s[np.minimum(np.searchsorted(s, theirs), n - 1)] == theirs
            inter = np.add.reduceat(hit.astype(np.int64), np.cumsum(self.lens[some]) - self.lens[some])
            for k in some[den * inter >= num * (self.lens[some] + n - inter)].tolist():
                old = int(self.comps[k])
                if old != component:
                    found.append((node, int(self.ids[k])))
                    self.root[old] = component
                    self.comps[self.comps == old] = component
            look = look[self.comps[look] != component]
        return found

    def among(self) -> list[tuple[int, int]]:
        """Links that join the members' components with each other."""
        self._close()
        sets = np.split(self.flat, self.starts[1:])
        return [x for k in range(1, len(self.ids)) for x in self.links(int(self.ids[k]), int(self.comps[k]), sets[k], k)]


def _apart(sets: DataFrame, open_: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that join all members of a centre's leaves that chains of links among them join.

    Two members of a leaf are both in its centre's group, where each comes once, however many leaves it shares with the
    centre. A group is dealt in ``blocks`` blocks. Each block is compared within itself, and each pair of blocks is one
    stream's work, its second block read against the first, so a task holds one block whatever the group's size. A pair
    that its components, its points or an earlier link of the stream decide is not compared, and only links that join
    two components become rows.
    """
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = _with_sets(open_.withColumn("at", at), sets)
    columns = ["centre", "i", "j", "passes", "node", "component", "set"]
    # a member waits in its own block and in the pairs (at, j) with j > at, and passes by the blocks i < at
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least("at", k).alias("i"), F.greatest("at", k).alias("j"), (k < F.col("at")).cast("int").alias("passes")))
    dealt = rows.withColumn("place", F.explode(places)).select("*", "place.*").select(*columns) \
        .repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "passes", "node")

    def run(batches):
        key, block = None, None
        for t in slices(batches, 6):
            found = []
            for centre, i, j, passing, node, comp, data in zip(*(t.column(k).to_pylist() for k in range(7))):
                if (centre, i, j) != key:
                    if key is not None and key[1] == key[2]:
                        found += block.among()
                    key, block = (centre, i, j), _Block(join, centre)
                s = np.frombuffer(data, "<u8")
                if not passing:
                    block.add(node, comp, s)
                elif block.ids is not None or block.members:
                    found += block.links(node, comp, s)
            yield _pairs(found)
        if key is not None and key[1] == key[2]:
            yield _pairs(block.among())

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    all_docs, linked = link_classes(docs, join)
    rows = all_docs.select("doc_id", "n_shingles", "node")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    named = stored(classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "components")
    classes = stored(attach(classes, named, "component", "classes").select("node", "n", "component_id"), "named")
    some = attach(rows.where("node IS NOT NULL"), classes, "node", "n").select("doc_id", "n_shingles", "component_id")
    none = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


@carrying("doc_id", "text")
def drop_near_copies(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``docs`` with one row of each group, that with the smallest doc_id, null ids last; all columns.

    Rows that share an id are told apart by their texts. Rows without shingles are in no group and stay.
    """
    cols = docs.columns
    marked = docs.withColumn("_row", row_key(F.col("text")))
    all_docs, linked = link_classes(marked, join)
    texts = all_docs.where("node IS NOT NULL").groupBy("node", "doc_id", "_row").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "n"))
    classes = texts.groupBy("node").agg(best.alias("best")).join(linked, "node", "left")
    chosen = classes.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best"))
    none = all_docs.where("node IS NULL").select("doc_id", "_row", F.lit(False)).distinct()
    kept = stored(chosen.select("best.doc_id", "best._row", F.col("best.n") > 1).union(none).toDF("_id", "_key", "_several"), "kept")

    def of(keys: DataFrame) -> DataFrame:
        return marked.join(keys.select("_id", "_key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")), "left_semi")

    several = kept.where("_several")
    out = of(kept.where("NOT _several")).select(*cols)
    if several.isEmpty():
        return out
    # rows that repeat an id and its text
    one = of(several).groupBy("doc_id", "_row").agg(F.min(F.struct(*cols)).alias("x"))
    return out.unionByName(one.select(*[F.col("x")[c].alias(c) for c in cols]))
