import random

import numpy as np
import pytest

from harrier.llm import curriculum, decontam, extract, hostrep, langid, media, ngram_join, rans, toxicity, warc
from harrier.llm.common import saved

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], DOCS)


def brute_pairs(texts, n=3, threshold=0.5):
    import re

    words = {k: re.findall(r"[0-9a-zÀ-￿]+", (t or "").lower()) for k, t in enumerate(texts)}
    grams = {k: {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} for k, w in words.items() if w}
    rep, out = {}, set()
    for k in sorted(grams):
        first = rep.setdefault(tuple(words[k]), k)
        if first != k:
            out.add((first, k, 1.0))
    nodes = sorted(rep.values())
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            if j >= threshold:
                out.add((a, b, round(j, 9)))
    return out


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(1, 40))) for _ in range(25)]
    texts = base + base[:5] + [b.replace(b.split()[0], "zz", 1) + " tail" for b in base] + [None, "", "...", "x " * 5000]
    got = {(r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert got == brute_pairs(texts)


def test_deduplicate_keeps_one_of_each_group(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g i", "q r s t u v", None, ""]
    assert sorted(r.doc_id for r in ngram_join.deduplicate(docs(spark, texts)).collect()) == [0, 3, 4, 5]
    assert ngram_join.deduplicate(docs(spark, texts).limit(0)).count() == 0


def test_classes_without_a_list_of_pairs(spark, monkeypatch):
    rng = random.Random(7)
    family = [f"f{k}" for k in range(40)]
    texts = [" ".join(w if rng.random() < 0.93 else f"x{rng.random()}" for w in family) for _ in range(60)]
    texts += [" ".join(rng.choice("abcd") * 2 for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pairs = {(a, b) for a, b, _ in brute_pairs(texts)}
    for grams, most in ((1 << 30, 1 << 30), (300, 1 << 30), (300, 100)):  # one slab, some, many
        monkeypatch.setattr(ngram_join, "SLAB_GRAMS", grams)
        monkeypatch.setattr(ngram_join, "SLAB_MOST", most)
        keys, classes, links = ngram_join.key_classes(docs(spark, texts))
        key = {r.doc_id: r.key for r in keys.collect()}
        low = {}
        for k in sorted(key):
            low.setdefault(key[k], k)
        count = {}
        for a, b in pairs:
            if key[a] != key[b]:
                for k in (a, b):
                    count[k] = count.get(k, 0) + 1
        assert {low[r.key]: r.links for r in links.collect()} == count and max(count.values()) > 20
        assert {low[r.node] for r in classes.collect()} == set(count)
        of = {low[r.node]: r.component for r in classes.collect()}
        assert all(of[a] == of[b] for a, b in pairs if key[a] != key[b])
        edges = len(pairs)
        found = ngram_join._links(*_survivors_of(spark, texts), 0.5, 4, 6)
        assert grams == 300 or found.count() <= len(set(key.values())) < edges / 2


def _survivors_of(spark, texts):
    _, survivors, blocks, *_ = ngram_join._blocks(docs(spark, texts), 3, 0.5)
    return survivors, blocks


def test_pipeline_drops_near_duplicates_without_a_list_of_pairs(spark, monkeypatch):
    import corpus_pipeline

    def listed(*_):
        raise AssertionError("pairs of a class were listed")

    monkeypatch.setattr(ngram_join, "_pairs", listed)
    texts = [" ".join(f"w{j}" for j in range(30)) + f" end{k}" for k in range(20)] + ["quite another text"]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "").collect()) == [0, 20]


def test_documents_that_cannot_be_near_form_no_block(spark):
    passages = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(31)]
    chain = [" ".join([passages[k], *(f"u{k}v{j}" for j in range(12)), passages[k + 1]]) for k in range(30)]
    _, blocks = _survivors_of(spark, chain + [chain[0] + " more"])
    assert blocks.count() == 2 and sum(r.links for r in ngram_join.near_duplicates(docs(spark, chain + [chain[0] + " more"])).collect()) == 2


def test_linked_loses_no_pair():
    rng = np.random.default_rng(3)
    for threshold in (0.3, 0.5, 0.8):
        sets = [rng.choice(60, rng.integers(1, 25), replace=False) for _ in range(60)]  # numbers are the global order
        sets = [np.sort(x) for x in sets] + [np.unique(np.r_[x[rng.integers(0, 2) :], rng.integers(60)]) for x in sets[:20]]
        place = [(k, g, len(x), len(x) - i) for k, x in enumerate(sets) for i, g in enumerate(x) if i <= len(x) - max(np.ceil(threshold * len(x) - 1e-9), 1)]
        columns = [np.array(x) for x in zip(*place)]
        edges = ngram_join._linked(columns[0].astype(np.int64), columns[1].astype(np.uint64), columns[2], columns[3], threshold)
        root = np.arange(80)
        if len(edges):
            ngram_join._unite(root, edges[:, 0], edges[:, 1])
        near = [(a, b) for a in range(80) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= threshold]
        assert near and all(root[a] == root[b] for a, b in near)


def test_linked_loses_no_pair_among_many_lists():
    lists, keys = 1 << 19, np.arange(1 << 20)
    grams = np.repeat(np.arange(lists, dtype=np.uint64), 2)
    sizes, rest = np.tile([100, 161], lists), np.tile([87, 87], lists)  # 87 shared grams: jaccard 0.5
    assert len(ngram_join._linked(keys, grams, sizes, rest, 0.5)) == lists
    assert len(ngram_join._linked(keys, grams, sizes + np.tile([0, 1], lists), rest, 0.5)) == 0


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item), (2, None), (3, item)], "item_id long, text string")
    texts = [f"Before it. {item} after it " + "filler " * 60, "clean words " * 30, None, "", item]
    got = {r.doc_id: r for r in decontam.decontaminate(docs(spark, texts), bench).collect()}
    assert set(got) == {0, 1, 2, 3} and got[0].removed_words == 14 and item not in got[0].text and got[1].text == texts[1]
    assert decontam.decontaminate(docs(spark, texts), bench.limit(0)).count() == 5


def test_automaton_finds_the_longest_matches():
    rng = random.Random(1)
    items = [[rng.randint(0, 3) for _ in range(30)] for _ in range(4)]
    auto = decontam.Automaton()
    for x in items:
        auto.add(x)
    words = [rng.randint(0, 3) for _ in range(300)]
    longest = max((j - i for x in items for i in range(30) for j in range(i + 1, 31) if any(words[k : k + j - i] == x[i:j] for k in range(300))), default=0)
    assert max(n for _, n in auto.flat().matches(np.array(words, np.uint64), 3)) == longest


def test_warc_transactions(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c?d", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    got = warc.assemble(warc.parse(warc.page_records(pages))).collect()
    assert len(got) == 2 and all(r.n_records == 3 and r.request.method == "GET" and r.response.status == 200 and len(r.metadata) == 1 for r in got)
    assert {bytes(r.response.payload) for r in got} == {b"<p>x</p>", b""}
    assert warc.assemble(warc.parse(warc.page_records(pages.limit(0)))).count() == 0


def test_language_id_on_given_documents(spark):
    rng = random.Random(2)
    words = {"en": "the and with house water under", "de": "der und mit haus wasser unter", "fr": "le et avec maison eau sous", "es": "el y con casa agua bajo"}
    rows = [(k, " ".join(rng.choice(words[x].split()) for _ in range(30)), x, "s", 0) for k, x in enumerate(list(words) * 30)] + [(999, None, None, "s", 0), (1000, "", "en", "s", 0)]
    got = langid.language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.lang == r.pred_lang for r in got if r.doc_id < 999) >= 118
    assert all(r.pred_lang is None for r in got if r.doc_id >= 999)


def test_thumbnails_against_block_means():
    rng = np.random.default_rng(3)
    pixels = np.kron(rng.integers(0, 256, (5, 7)), np.ones((8, 8)))
    for restart in (0, 4):
        status, width, height, parts, tw, th, thumb, name = media.thumbnails([media.encode_grey([pixels], restart)[0]])[0]
        assert (status, width, height, parts, tw, th) == ("ok", 56, 40, 1, 7, 5) and len(name) == 16
        assert np.abs(np.frombuffer(thumb, np.uint8).reshape(5, 7).astype(float) - pixels[::8, ::8]).max() <= 2
    assert [r[0] for r in media.thumbnails([None, b"", b"GIF8", media.encode_grey([pixels])[0][:100]])] == ["null", "empty", "not a JPEG", media.thumbnails([media.encode_grey([pixels])[0][:100]])[0][0]]


def test_reputation(spark):
    pages = spark.createDataFrame([(k, f"https://h{k % 2}.site.co.uk/{k}") for k in range(20)] + [(99, None)], "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], LABELS)
    got = {r.page_id: r for r in hostrep.reputation(pages, labels).collect()}
    assert got[0].domain == "site.co.uk" and got[1].reputation > got[99].reputation > got[0].reputation and got[99].host is None


def test_extraction():
    page = extract.extract("<title>T &amp; t</title><nav><p>menu, menu, menu, menu, menu, menu</p></nav><div><p>A long paragraph, with commas, and words enough to count.</p><p>Another one, with some more words in it, too.</p></div><!-- x")
    assert page.title == "T & t" and page.text.startswith("A long paragraph") and "menu" not in page.text and page.paragraphs == 2
    assert extract.extract(None).text == "" and extract.extract("a < b <<").text


@pytest.mark.parametrize("block", [64, 256])
def test_token_blocks_round_trip(spark, block):
    import tiktoken  # noqa: F401

    texts = ["Hello  world,\nit's 2024! ", None, "", "é€ tab\tand more " * 50, "Hello  world,\nit's 2024! "]
    table = docs(spark, texts)
    packed = saved(rans.pack(table, block_tokens=block, checkpoint=32))
    parts: dict = {}
    for r in sorted(rans.unpack(packed).collect(), key=lambda r: (r.doc_id, r.start)):
        parts.setdefault(r.doc_id, []).extend(r.tokens)
    coder = rans.tokenizer(rans.read_vocabulary(rans.VOCABULARY)).coder
    assert parts == {k: coder.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_checkpoint_decodes_the_rest():
    rng = np.random.default_rng(4)
    block = rng.integers(0, 50, 1000).astype(np.uint32)
    table = rans.Table(rans.scaled(np.bincount(block, minlength=50)))
    (states, words, marks) = rans.encode_blocks([block], table, checkpoint=128)[0]
    assert (rans.decode(states, words, table, 1000) == block).all()
    for token, word, at in marks:
        assert (rans.decode(at, words[4 * word :], table, 1000 - token) == block[token:]).all()


def test_toxicity(spark):
    rng = random.Random(6)
    plain = "river house garden window table summer walk".split()
    rows = [(k, " ".join(rng.choices(plain, k=20)) + (" idiot stupid scum" if k % 4 == 0 else ""), "en", "s", 0) for k in range(200)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    table = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(160)], LABELS)
    kept = {r.doc_id for r in toxicity.reject_toxic(table, labels).collect()}
    assert kept == {k for k, *_ in rows if not (k < 200 and k % 4 == 0)}
    assert toxicity.reject_toxic(table, labels.limit(0)).count() == len(rows)


def test_mix_order_and_counts(spark):
    rows = [(k, "w " * (k % 7 + 1), "en", "ab"[k % 2] if k % 5 else None, 0) for k in range(200)]
    table = spark.createDataFrame(rows, DOCS)
    got = curriculum.mix(table).collect()
    assert {r.doc_id for r in got} == set(range(200)) and [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position < 1 for r in got)
    again = curriculum.mix(table, bucket_rows=5).collect()
    assert {(r.doc_id, r.epoch, round(r.position, 9)) for r in got} == {(r.doc_id, r.epoch, round(r.position, 9)) for r in again}
    assert curriculum.mix(table.limit(0)).count() == 0
    assert curriculum.mix(table.unionByName(table)).count() >= 400


def test_blocks_keep_the_training_order(spark):
    import corpus_pipeline

    rows = [(k, ("w " if k % 2 else "".join(random.Random(k).choices("bcdfghklmnpqrstz", k=60)) + " ") * (k % 9 + 1), "en", "yx"[k % 2], 0) for k in range(400)] + [(900, None, "en", "x", 0)]
    table = spark.createDataFrame(rows, DOCS)
    want = [r.doc_id for r in curriculum.mix(table).collect()]
    packed = corpus_pipeline.pack_tokens(spark, saved(corpus_pipeline.mix_sources(spark, table, "")), "").where("block_id >= 0").collect()
    assert [d for r in sorted(packed, key=lambda r: r.block_id) for d, start in zip(r.doc_ids, r.doc_starts) if start == 0] == want


def test_blocks_keep_the_order_of_the_input(spark):
    table = spark.range(400, numPartitions=4).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), cast(1 + id / 40 AS int)) AS text")
    packed = rans.pack(table).where("block_id >= 0").collect()
    assert [d for r in sorted(packed, key=lambda r: r.block_id) for d, start in zip(r.doc_ids, r.doc_starts) if start == 0] == list(range(400))


def test_toxicity_does_not_depend_on_the_cut_of_a_class(spark):
    # the word is in all toxic documents (10 %) and in 30 % of the clean ones: a document with it is toxic at 0.27
    rows = [(k, "river house" + (" mark" if k % 10 in (0, 1, 2, 3) and (k % 10 == 0 or k % 30 != 1) else ""), "en", "s", 0) for k in range(600)]
    table, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(600)], LABELS)
    whole, cut = (toxicity.score(table, toxicity.fit(table, labels, rows_per_class=n)).where("doc_id = 0").first().p_toxic for n in (5000, 60))
    assert whole < 0.35 and abs(whole - cut) < 0.1


def test_toxicity_keeps_every_word_that_marks(spark):
    # 300 words that each mark ten toxic documents, in groups of three; all have the same gain
    rows = [(k, f"river house m{k // 10}a m{k // 10}b m{k // 10}c", "en", "s", 0) for k in range(1000)] + [(k, "river house", "en", "s", 0) for k in range(1000, 3000)]
    table, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, 1, int(k < 1000)) for k, *_ in rows], LABELS)
    chain = toxicity.fit(table, labels)
    assert len(chain.words) == 300
    assert toxicity.score(table, chain).where("toxic").count() == 1000


def test_sparse_logistic_is_at_the_minimum():
    rng = np.random.default_rng(7)
    z, more = rng.random((300, 20)) < 0.2, rng.random((300, 2))
    y, weight = (rng.random(300) < 0.2 + 0.5 * z[:, 0]).astype(float), rng.choice([1.0, 4.0], 300)
    w, v, c = toxicity._logistic(toxicity.Presence(*np.nonzero(z), 300, 20), more, y, weight)
    off = weight * (y - 1 / (1 + np.exp(-(z @ w + more @ v + c))))
    assert np.abs(np.r_[z.T @ off - w, more.T @ off - v, off.sum() - 1e-3 * c]).max() < 1e-3


def test_deduplicate_decides_by_row(spark):
    a, b, c, d = "a b c d e f g h", "q r s t u v w x", "k l m n o p aa bb", "cc dd ee ff gg hh ii jj"
    rows = [(1, a), (2, a + " i"), (2, b), (2, ""), (3, c), (3, d), (3, c), (4, b + " y"), (5, "zz yy xx"), (None, d), (None, "one two three four"), (None, "One, two three four"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, (r.text or "").lower().replace(",", "")) for r in ngram_join.deduplicate(table).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (2, ""), (3, c), (3, d), (5, "zz yy xx"), (None, "one two three four"), (None, "")], key=str)


def test_a_match_counts_for_every_item_that_holds_it(spark):
    shared = " ".join(f"s{k}" for k in range(10))
    long, short = "a first " + shared + "".join(f" l{k}" for k in range(60)), shared + " b0 b1 b2 b3 b4 b5"
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(60))
    # the second text goes on as in the long item, so its longest match is of that one
    got = {r.doc_id: r for r in decontam.decontaminate(docs(spark, [f"{filler} {shared} {filler}", f"{filler} {shared} l0 l1 {filler}", f"{filler} l1 l2 l3 l4 l5 l6 l7 l8 l9 {filler}"]), bench).collect()}
    assert [[tuple(s) for s in got[k].spans] for k in range(3)] == [[(60, 70)], [(60, 70)], []]


def test_transactions_through_any_links(spark):
    rows = [
        ("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["q1"]), ("n1", "metadata", ["m1"]), ("o1", "metadata", ["n1"]),  # four links
        ("q2", "request", ["m2"]), ("m2", "metadata", ["q2"]),  # no response
        ("q3", "request", ["lost"]), ("m3", "metadata", ["lost"]),  # the response's record is lost
        ("r4", "response", []), ("r5", "response", ["r4"]), ("q5", "request", ["r5"]), ("m5", "metadata", ["q5", "r4"]), ("q6", "request", None),
    ]
    records = spark.createDataFrame([(i, k, c, "u", "d", "", "", bytearray(b""), "", False) for i, k, c in rows], warc.RECORD_SCHEMA)
    assert {r.record_id: r.capture_id for r in warc.transactions(records).collect()} == {
        "r1": "r1", "q1": "r1", "m1": "r1", "n1": "r1", "o1": "r1", "q2": "m2", "m2": "m2", "q3": "m3", "m3": "m3", "r4": "r4", "r5": "r5", "q5": "r5", "m5": "r4", "q6": "q6",
    }
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert {k: r.n_records for k, r in got.items()} == {"r1": 5, "m2": 2, "m3": 2, "r4": 2, "r5": 2, "q6": 1}
    assert got["m2"].response is None and got["m2"].request.record_id == "q2" and [m.record_id for m in got["r1"].metadata] == ["m1", "n1", "o1"]
