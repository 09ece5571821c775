"""Edge cases and brute-force comparisons of the operators."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, exact_dedup, mixing, neighbours, quality, queries, toxicity, url_filter, wrapper

DOCS = "doc_id long, text string, source string, size int, TEXT2 string"
ROWS = [(1, "a b c", "s1", 0, "x"), (2, "ab\tc\n", "s1", 0, "x"), (3, None, None, 0, "x"), (4, "", "s2", 0, "x"), (5, "abc", "s2", 0, None),
        (5, "abc", "s2", 0, None), (None, "zz", "s1", 0, "x"), (7, "w " * 30_000, "s3", 0, "x"), (8, "Ä ö", None, None, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


# -- exact duplicates ------------------------------------------------------------------------------------------------


def test_fingerprints_compose():
    rnd = random.Random(3)
    for n in (0, 1, 7, 300):
        data = rnd.randbytes(n)
        whole = exact_dedup.fingerprint(data)
        assert all(exact_dedup.fingerprint(data, k) == whole for k in (1, 3, 64, 1000))
        assert exact_dedup.combine(exact_dedup.fingerprint(data[: n // 3]), exact_dedup.fingerprint(data[n // 3 :])) == whole
        assert whole == (int.from_bytes(data, "big") % exact_dedup.PRIME, n)


def test_exact_groups(spark, docs):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].keep_id == by[2].keep_id == by[5].keep_id == 1 and by[1].group_size == 4 and by[1].kept and not by[5].kept
    assert by[3].keep_id == by[4].keep_id == 3 and by[4].group_size == 2 and by[None].kept and by[7].kept
    assert by[2].text_sha256 == hashlib.sha256(b"abc").hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "7", "8", "None"]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


# -- mixing ----------------------------------------------------------------------------------------------------------


def test_targets_and_pieces(spark, docs):
    pieces, placed = mixing.mix(docs, block=64)
    got = mixing.taken(docs, block=64).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) <= 5
    rows = pieces.orderBy("slot").collect()
    assert all(0 < r.to_word - r.from_word <= 64 and 0 <= r.from_word < r.to_word <= r.size for r in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs, block=64).collect()))
    assert mixing.taken(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


# -- toxicity and quality ----------------------------------------------------------------------------------------------


def test_disguised_words():
    model = toxicity.Restorer({}, {"idiot": 0.9, "worthless": 0.9})
    for text in ("1d10t", "i d i o t", "so i.d.i.o.t!", "IDIIIOT!!", "!diot", "w0rthle$$", "w o r t h l e s s"):
        assert model.hits(text), text
    for text in ("", "a b c d e f", "12.5.2024 10:30", "idiom", "x" * 5000, "i " * 2000):
        assert not model.hits(text), text


def test_scores_on_held_out_rows(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    for scored, label in ((toxicity.toxicity(docs, labels), "toxic"), (quality.quality(docs, labels), "quality")):
        rows = scored.join(labels, "doc_id").where("held_out").collect()
        assert rows and np.mean([r.predicted == r[label] for r in rows]) > 0.8
        assert all(0 <= r.score <= 1 for r in rows)


def test_scores_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for scored in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
        assert scored.count() == len(ROWS) and scored.where("score IS NULL").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_machine_uses_the_pairwise_identity():
    starts, ids, x = quality.features([b"one two two", b"", b"x|y|z\nEND !!"])
    m = quality.Machine()
    m.v = np.random.default_rng(0).normal(size=m.v.shape)
    raw, _ = m.raw(starts, ids, x)
    for r, (a, z) in enumerate(zip(starts[:-1], starts[1:])):
        pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(a, z) for j in range(i + 1, z))
        assert abs(raw[r] - pairs) < 1e-9


# -- chat ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [*chat.CONTROLS, "<\\|end|>", "<<SYS>>\\", "[\\\\INST][/INST]", "</s>[INST] ok [/INST]", "", "<|turn", "plain \\ text"])
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_conversations(spark):
    import public_tokenizers

    texts = ["</s>[INST] ok [/INST]", "", None, "naïve 🤖\n x", "  <|text|> "]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "assistant", "assistant", None], texts))] + [(None, None, "assistant", "x"), (2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df, open(public_tokenizers.path("byte_bpe_50k.json")).read())
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:5])
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].n_turns == 5
    assert got[1].loss_sha256 == hashlib.sha256("naïve 🤖\n x".encode()).hexdigest() and got[1].loss_chars == 10
    assert got[None].loss_chars == 1 and got[2].loss_chars == 0


def own_steps(spark, monkeypatch):
    """What a task of ``format_conversations`` and one of ``read_back`` run on their Arrow batches."""
    import public_tokenizers

    rows, steps = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"), []
    whole = type(rows).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(rows), "mapInArrow", lambda df, run, schema: steps.append((run, df.columns)) or whole(df, run, schema))
        chat.read_back(chat.format_conversations(rows, open(public_tokenizers.path("byte_bpe_50k.json")).read()))
    return steps


def test_memory_of_conversations_does_not_follow_the_rows_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH", 1 << 16, raising=False)
    (make, _), (read, columns) = own_steps(spark, monkeypatch)
    texts = [f"{word} " * 80 for word in ("naïve", "ok then", "1 2", "what")]
    roles = ["user", "assistant"] * 2

    def peak(run, batch):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    few, many = (pa.RecordBatch.from_pydict({"conv_id": list(range(n)), "roles": [roles] * n, "texts": [texts] * n}) for n in (100, 800))
    assert sum(made.num_rows for made in make(iter([many]))) == 800
    assert peak(make, many) < 2 * peak(make, few)
    made = pa.Table.from_batches(make(iter([many]))).select(columns).combine_chunks().to_batches()
    assert len(made) == 1 and peak(read, made[0]) < 1000 * many.num_rows  # of its digests


def test_long_conversation_is_encoded_as_a_whole(spark, monkeypatch):
    import public_tokenizers

    (make, _), (read, columns) = own_steps(spark, monkeypatch)
    texts = ["naïve 🤖\n x", "", "  <|text|> ", "it's 12 \n\n", "日本", "</s>[INST] ok "] * 1500
    roles = (["assistant", "user", "assistant"] * 3000)[: len(texts)]
    made = pa.Table.from_batches(make(iter([pa.RecordBatch.from_pydict({"conv_id": [7], "roles": [roles], "texts": [texts]})])))
    formatted, spans = chat.render(list(zip(roles, texts)))
    row, want = made.to_pylist()[0], chat.tokenizer(open(public_tokenizers.path("byte_bpe_50k.json")).read()).encode(formatted, add_special_tokens=False)
    assert len(formatted) > 2 * chat.PIECE and row["formatted"] == formatted and row["ids"] == want.ids
    assert list(zip(row["token_starts"], row["token_ends"])) == want.offsets
    span_of = [0] * len(formatted)
    for k, (a, z) in enumerate(spans, 1):
        span_of[a:z] = [k] * (z - a)
    assert row["loss"] == [int(span_of[x] > 0 and span_of[y - 1] == span_of[x]) for x, y in want.offsets]
    back = pa.Table.from_batches(read(iter(made.select(columns).combine_chunks().to_batches()))).to_pylist()[0]
    assert back["loss_sha256"] == hashlib.sha256("".join(t for r, t in zip(roles, texts) if r == "assistant").encode()).hexdigest()
    assert (back["n_turns"], back["n_tokens"], back["n_loss_tokens"]) == (len(texts), len(want.ids), sum(row["loss"]))


@pytest.mark.parametrize("tokens, loss, want", [([], [], ""), ([(0, 2), (2, 4)], [0, 0], ""), ([(0, 0), (0, 1)], [1, 1], "a"), ([(0, 1), (1, 2), (1, 2), (2, 4), (6, 8)], [1, 1, 1, 0, 1], "abgh"), ([(1, 2), (1, 3), (2, 3), (5, 6)], [1, 1, 1, 1], "bcf")])
def test_text_under_a_mask(tokens, loss, want):
    assert chat.masked_text("abcdefgh", tokens, loss) == want


# -- pages -----------------------------------------------------------------------------------------------------------


def test_article_text():
    page = ("<!DOCTYPE html><html><head><title>T</title><script>var t='</p>'</script></head><body><nav><li>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1>"
            "<p><b>One<br>two.<br><p>Three\n  four &lt; 5<div class=\"comments\"><p>troll</div><aside>x</aside><form>f</form></article><footer>&copy;</footer>")
    assert wrapper.extract(page) == "A & B\nOne two.\nThree four < 5"
    for odd in ("", "<", "<p", "</div></p>", "<!-- x", "plain", "<a href=\"" * 300, "<p>" * 3000 + "deep", "<div>" * 3000 + "deep"):
        assert wrapper.extract(odd) in ("", "<", "<p", "plain", "deep") or odd.startswith("<a")


def test_template_of_a_host(spark):
    def page(i):
        return f"<body><div class=top>Site name and slogan</div><div class=body><div class=x><h2>T{i}</h2><p>Text {i} here.<p>More {i * 7}.</div><div class=end>Read on elsewhere</div></div>"

    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(8)] + [(90, None, "<p>alone"), (91, "http://two.example/", None), (91, "http://two.example/", None)]
    got = {(r.page_id): r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\nText 3 here.\nMore 21." and got[90] == "alone" and got[91] == ""


def test_alignment_decides_within_marked_elements(spark):
    def shared(i):  # a slot that all articles share is template, one that differs on a page is that page's own
        return f"<article><h1>T{i}</h1><p>Text {i}.</p><div class=end>{'Own end' if i == 5 else 'Read on elsewhere'}</div></article>"

    def teasers(i):
        return f"<main><h1>M{i}</h1><p>{'A long body. ' * 9}{i}</p></main><section><article>Teaser {i + 1}</article></section>"

    def form(i):
        return f"<form id=page><div class=ad>Buy {i}</div><h1>F{i}</h1><p>{'All is within a form. ' * 9}{i}</p></form>"

    made = {"shared": shared, "teasers": teasers, "form": form}
    rows = [(f"{name}{i}", f"http://{name}.example/{i}", make(i)) for name, make in made.items() for i in range(20)]
    got = {r.page_id: r.text.split("\n") for r in wrapper.main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got["shared3"] == ["T3", "Text 3."] and got["shared5"] == ["T5", "Text 5.", "Own end"]
    assert got["teasers3"] == ["M3", "A long body. " * 9 + "3"] and got["form3"] == ["F3", "All is within a form. " * 9 + "3"]


def test_simple_tree_matching():
    a = [(0, "#", 1), (1, "div", 2), (2, "p", 3), (1, "ul", 4)]
    b = [(0, "#", 1), (1, "h1", 9), (1, "div", 2), (2, "p", 5), (2, "b", 6), (1, "ul", 4)]
    assert wrapper.align(a, b) == [(0, 0), (1, 2), (2, 3), (3, 5)] and wrapper.align([], b) == []


# -- urls ------------------------------------------------------------------------------------------------------------


def test_rules_and_mined_tokens(spark):
    urls = ["http://a.ORG/x", "https://www.example.org/es/1", "https://example.org/en/100", "http://x.com/fr/", "http://com/de/1", "http://b.net/spam/1?u=2", "http://b.net/ok/1", None, "no scheme", "http://notexample.org?q", "http://h.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    mined = spark.createDataFrame([(["path=spam", "host=b.net"], 0.9, 0.1)], "antecedent array<string>, confidence double, support double")
    got = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES, mined).collect()}
    assert [got[i].rule for i in range(11)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [got[i].verdict for i in range(11)] == ["allow", "block", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert (got[0].host, got[0].path, got[7].host, got[8].path) == ("a.org", "/x", "", "")


def test_mining_against_counts(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = rnd.random() < 0.3
        rows.append((i, f"http://{rnd.choice('abc')}.net/{'spam' if bad and rnd.random() < 0.9 else rnd.choice(['news', 'blog'])}/{i}"))
        labels.append((i, 0 if bad else 1, 0))
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {tuple(sorted(r.antecedent)): r.confidence for r in url_filter.mine(pages, known).collect()}
    tokens = [(set(r.t), labels[r.page_id][1] == 0) for r in pages.select("page_id", url_filter.tokens_of(F.col("url")).alias("t")).collect()]
    assert ("path=spam",) in found
    for rule, confidence in found.items():
        hits = [bad for t, bad in tokens if set(rule) <= t]
        assert sum(hits) >= url_filter.MIN_PAGES and abs(sum(hits) / len(hits) - confidence) < 1e-9 and confidence >= 0.5
    assert url_filter.mine(pages.limit(0), known).count() == 0


# -- neighbours --------------------------------------------------------------------------------------------------------


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))[:k]
    return out


def test_recall_and_odd_vectors(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(10_001, None), (10_002, [0.0] * 64), (10_003, [float("nan")] * 64), (10_004, [None] * 64), (None, [1.0] * 64), (10_005, rows[0][1]), (10_006, rows[0][1]), (10_100, [1.0, 2.0]), (10_101, [1.0, 3.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    want = brute(rows)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert found.keys() == want.keys() and found[10_100] == [(1.0, 10_101)] and [v for _, v in found[0][:2]] == [10_005, 10_006]
    assert np.mean([len({v for _, v in found[q]} & {v for _, v in want[q]}) / len(want[q]) for q in want]) >= 0.9
    assert neighbours.nearest(spark.createDataFrame(rows[:0], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_rows_that_repeat_an_id_take_one_place(spark):
    rnd = np.random.default_rng(11)
    q = rnd.normal(size=16)
    rows = [(100, q.tolist())] + [(7, (q + 1e-3 * rnd.normal(size=16)).tolist()) for _ in range(25)] + [(i, (q + 0.01 * i * rnd.normal(size=16)).tolist()) for i in range(20, 45)]
    rows += rows[-25:] * 3
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100).orderBy("rank").collect()
    least = {}
    for i, v in rows[1:]:
        least[i] = min(least.get(i, np.inf), float(np.sqrt(((np.array(v) - q) ** 2).sum())))
    want = sorted((s, i) for i, s in least.items())[:10]
    assert [r.vec_id for r in got] == [i for _, i in want] and np.allclose([r.score for r in got], [s for s, _ in want])


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_stem_counts_only_when_repeated():
    from tickloom.llm.toxicity import Restorer, _related, entries

    assert {"zorkel", "zork+2"} <= entries(["zorkel", "zorkan", "mild"]) and "zork+3" not in entries(["zorkel", "zorkan"])
    model = Restorer({}, {"zork+2": 0.9, "loser": 0.9})
    assert model.hits("a Zorkel, met zorkan") == {"zork+2"}
    assert model.hits("one zorkel met a mild zork") == set()  # the stem itself is no word that continues it
    assert model.hits("") == set() and model.hits("Loser!") == {"loser"}
    assert _related("zork+2", "zorkel") and _related("zork+2", "zor+3") and not _related("idiot", "idiots")


def test_disguised_stems():
    for lexicon in ({"zork+2": 0.9}, {"zork+2": 0.9, "bad": 0.9}):  # stems alone, and words shorter than what begins with a stem
        model = toxicity.Restorer({}, lexicon)
        for text in ("z0rkel z0rkan", "z.o.r.k.e.l zorkan", "a zorkelissimo and z0rkelissimo", "z o r k e l so z 0 r k a n", "z o r k e l z o r k a n"):
            assert model.hits(text) == {"zork+2"}, text
        for text in ("z0rkel", "z o r k z o r", "z0rk z0rk", "12.5.2024 http://x.example/z0rkel"):
            assert not model.hits(text), text
    assert toxicity.Restorer({}, {"zo": 0.9}).hits("z . o") == {"zo"}


def test_alphabetic_disguises():
    model = toxicity.Restorer({}, {"idiot": 0.9, "loser": 0.9, "zork+2": 0.9})
    for text in ("idiiot", "looser", "iiddiioott", "idi\u043et", "l\u043es\u0435r!", "\uff49\uff44\uff49\uff4f\uff54", "zorrkel z\u043erkan"):
        assert model.hits(text), text
    for text in ("idiom lotter", "\u043e\u0440\u0435\u0445", "zoorkel", "letters add up"):
        assert not model.hits(text), text


@pytest.mark.parametrize("word", ["f**k", "**", "i*i**", "a1*!", "*#*1"])
def test_decoder_finds_the_best_path(word, monkeypatch):
    import itertools

    monkeypatch.setattr(toxicity, "LETTERS", "abcfikl")  # few enough for all paths
    rnd = np.random.default_rng(7)
    model = toxicity.Restorer({}, {})
    model.logp = np.log(rnd.dirichlet(np.full(toxicity.SIZE, 0.05), (toxicity.SIZE, toxicity.SIZE)) + 1e-9).astype(np.float32)

    def score(path):
        a, b, s = toxicity.EDGE, toxicity.EDGE, 0.0
        for k, cost in path:
            s += cost
            if k is not None:
                s += float(model.logp[a, b, k])
                a, b = b, k
        return s + float(model.logp[a, b, toxicity.EDGE])

    names = "abcdefghijklmnopqrstuvwxyz"
    best = max(itertools.product(*model.lattice(word)), key=score)
    want = "".join((names[k] if k < len(names) else "?") for k, _ in best if k is not None)
    monkeypatch.undo()
    for dense in (0, 10**9):
        monkeypatch.setattr(toxicity, "DENSE", dense)
        model.lattice = lambda w, own=[list(x) for x in small_lattice(model, word)]: own
        assert model.decode(word) == want


def small_lattice(model, word):
    """The lattice whose wildcards stand for a to g only."""
    return [[(k, c) for k, c in own if k is None or c != -4.0 or k < 7] for own in toxicity.Restorer.lattice(model, word)]


def test_pages_with_columns_of_the_labels(spark):
    pages = spark.createDataFrame([(i, f"https://bad.example.net/x/{i}?a=1", i, 1, 0) for i in range(60)], "page_id long, url string, doc_id long, toxic int, quality int")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    rules = url_filter.mine(pages, labels)
    assert url_filter.judge(pages, [], rules).count() == 60 and url_filter.judge(pages.limit(0), [], rules).count() == 0
