"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
import re
import time

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import bpe, common, mixing, toxicity
from tickloom.llm.jaccard_join import Join

from test_jaccard_join import brute


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "bpe"]

    clean = stages["toxicity"](spark, docs, small).cache()
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad

    single = stages["exact_dedup"](spark, clean, small).cache()
    best = {}
    for r in sorted(clean.collect(), key=lambda r: (-len(r.text or ""), r.doc_id)):
        best.setdefault(norm(r.text), r.doc_id)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(best.values())

    apart = stages["ngram_jaccard_join"](spark, single, small).cache()
    want = sorted(d for d, _, c in brute([(r.doc_id, r.text) for r in single.collect()], Join()) if d == c)
    assert apart.columns == docs.columns and sorted(r.doc_id for r in apart.collect()) == want

    mixed = stages["mix_sources"](spark, apart, small).cache()
    times = {r.doc_id: 1 if r.size == 0 else int(np.floor(r.taken / r.size + 0.5)) for r in mixing.taken(apart).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and {d: got.count(d) for d in times} == times and max(times.values()) <= 2

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in apart.collect()}
    rows = stages["bpe"](spark, mixed, small).collect()
    assert len(rows) == len(got)
    for r in rows:
        ids = other.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_rows_that_share_an_id(spark):
    from pyspark.sql import functions as F
    from tickloom.llm.jaccard_join import drop_near_copies

    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base, f"x{k}"])
    other = lambda k: " ".join(f"o{k}-{i}" for i in range(40))
    rows = [(1, near(1), "a"), (1, near(2), "a"), (1, other(1), "a"), (2, near(3), "a"), (2, other(2), "b"), (2, other(2), "b"),
            (None, near(4), "a"), (None, other(3), "b"), (None, other(3) + " end", "b"), (5, "", "a"), (5, "", "a"), (5, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in drop_near_copies(docs, Join(words=5, num=4, den=5)).collect())))
    ones = [x for x in got if "w59" in x]
    assert len(ones) == 1 and ones[0].startswith("(1,")
    assert [sum(f"o{k}-39" in x for x in got) for k in (1, 2, 3)] == [1, 1, 1] and len(got) == 4 + 3

    rows = [(7, "a b c d", "s"), (7, "e f", "s"), (7, "g h", "s"), (7, "g h", "s"), (None, "i j k", "t"), (None, "l", "t"), (8, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    own = mixing._taken(docs.withColumn("_row", F.col("text").cast("binary")), share=0.5).collect()
    mixed = [tuple(r) for r in mixing.mixed_documents(docs, share=0.5).collect()]
    words = sum(len(t.split()) for _, t, _ in mixed)
    assert abs(words - sum(r.taken for r in own)) <= 4 and (8, "", "t") in mixed
    assert mixing.mixed_documents(docs, share=2.0).count() == 2 * 6 + 1


def test_mix_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, 1.5 * sum(sizes.values()), list(names)
    while free:  # a source can give its words twice; what it can't give goes to the others by weight
        full = [s for s in free if weight[s] * rest / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not full:
            target |= {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(target[s] for s in full)
        free = [s for s in free if s not in full]
    want = []
    for s in names:
        start, quota = 0, int(np.floor(target[s] + 1e-9))
        for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), r[0])):
            took = sum(max(0, min(quota, start + e * sizes[s] + n) - start - e * sizes[s]) for e in (0, 1))
            want += [d] * (1 if n == 0 else int(np.floor(took / n + 0.5)))
            start += n
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["mix_sources"](spark, docs, small).collect()]
    assert sorted(got) == sorted(want)


def test_toxic_rows_against_all_paths(spark, tmp_path):
    import itertools
    import random

    rnd = random.Random(4)
    fill = ["".join(rnd.choice("bcdfghkmnprtv") + rnd.choice("aeiou") for _ in range(3)) for _ in range(60)]
    rows = [(i, " ".join(rnd.choices(fill, k=8) + ([rnd.choice(["idiot", "loser"])] if i % 3 == 0 else []))) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(180)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    lexicon, p0 = toxicity.learn(docs, labels)
    words = sorted(w for w in lexicon if "+" not in w and w.isascii() and 4 <= len(w) <= 9)[:4]
    assert {"idiot", "loser"} <= set(words) and not any("+" in w for w in lexicon)
    swaps, letters = {"i": "1", "o": "0", "e": "3", "a": "4", "s": "5", "t": "7"}, {"1": "il", "0": "o", "3": "e", "4": "a", "5": "s", "7": "t"}
    own = [x for w in words for x in (w, "".join(swaps.get(c, c) for c in w), ".".join(w), w[0] + w, w[:2] + "17" + w[2:])] + ["mild", "12.50", "a-b-c"]
    every = docs.unionByName(spark.createDataFrame([(10**6 + i, f"so {x} then") for i, x in enumerate(own)], "doc_id long, text string"))
    model = toxicity.fit(every, labels).value[0]
    assert model.lexicon == lexicon

    def restored(token):
        """The best of all paths, spelled out."""
        ways, before = [], ""
        for c in token:
            way = [(x, -0.7) for x in letters[c]] + [("?", -6.0)] if c in letters else [("", -0.05)] if c in ".-" else [(c if c.isalpha() else "?", -0.05 if c.isalpha() else -0.1)]
            ways.append(way + [("", -0.5)] * (c == before))
            before = c

        def score(path):
            a, b, s = toxicity.EDGE, toxicity.EDGE, 0.0
            for c, cost in path:
                s += cost
                if c:
                    k = toxicity.INDEX.get(c, toxicity.OTHER)
                    s, a, b = s + float(model.logp[a, b, k]), b, k
            return s + float(model.logp[a, b, toxicity.EDGE])

        return "".join(c for c, _ in max(itertools.product(*ways), key=score))

    once = lambda w: re.sub(r"(.)\1+", r"\1", w)
    found = lambda x: [w for w in lexicon if "+" not in w and (w == x or (not x.isalpha() or re.search(r"(.)\1", x)) and once(w) == once(restored(x)))]
    toxic = {10**6 + i for i, x in enumerate(own) if 1 - (1 - p0) * np.prod([1 - lexicon[w] for w in found(x)]) >= 0.5}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, every, str(tmp_path)).collect()}
    assert toxic and {i for i in range(10**6, 10**6 + len(own)) if i not in kept} == toxic
    for i, text in rows:
        odd = 1 - (1 - p0) * np.prod([1 - lexicon[w] for w in {w for t in text.split() for w in found(t)}]) >= 0.5
        assert odd == (i % 3 == 0) == (i not in kept)


def test_extra_columns_of_any_name_come_through(spark, small):
    """Names that the stages use themselves, with values of several kinds."""
    import corpus_pipeline

    names = ["_row", "_sha2", "_sha", "_id", "_id2", "_n2", "_n", "_one", "_toxicity", "_times", "_each", "_key", "node", "source_size", "size", "n", "best", "score", "a.b", "_carried", "taken"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    extra = {c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in names}
    wide = docs.withColumns(extra).withColumn("word", F.array(F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, small), stage(spark, wide, small)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect()) and rows, name
        assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in names) and all(r.word == [r.doc_id] for r in rows), name


def test_stored_steps_leave_no_shuffle_files(spark):
    """Steps of a stage that write their results do not pile up the shuffles behind them."""
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())} - {""}

    before, setting = shuffles(), spark.conf.get(common.DROP_SHUFFLES)
    rows = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = common.stored(rows, "steps")
    assert {r["k"]: r["count"] for r in kept.collect()} == {k: len(range(k, 5000, 7)) for k in range(7)}
    for _ in range(50):
        if not (left := {f for f in shuffles() - before if f.startswith("shuffle_")}):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(common.DROP_SHUFFLES) == setting
    # what was stored can be computed again from where it came
    assert rows.count() == 7 and rows.count() == 7
