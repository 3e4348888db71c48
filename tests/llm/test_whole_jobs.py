"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import decontaminate, language_id, secret_scan, top_k, warc
from siftlake.llm.common import held_out


def test_edited_copies_beside_a_verbatim_one(spark):
    item = [f"w{k}" for k in range(40)]
    edited = [w if k % 5 else None for k, w in enumerate(item)]
    rows = [(d, " ".join(w or f"x{d}" for w in edited)) for d in range(100)] + [(100, " ".join(item))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == set(range(101))


def test_pages_with_very_long_urls_are_read(spark):
    rng = random.Random(3)
    urls = ["http://a/" + "x" * 70_000, "http://a/" + "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(300_000)), "http://a/" + "y" * 500_000, "http://b/"]
    rows = [(k, urls[k % 4], f"page {k}") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for split in (500, 50_000, 8 << 20):
        assert sorted(r.page_id for r in warc.archive_and_read(pages, split_bytes=split).collect()) == list(range(12))


def test_quality_scores_written_out(spark, tables):
    """Scores of all documents against vectors of words and n-grams, their mean over words, the layer and the softmax, one by one."""
    from siftlake.llm import quality

    docs = tables("documents")
    model = quality.fit(docs, tables("labels"), usable=~held_out())
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    vectors: dict[str, np.ndarray] = {}

    def vector(word: str) -> np.ndarray:
        if word not in vectors:
            buckets, owners = quality.features([word], model.settings)
            assert set(owners.tolist()) == {0}
            vectors[word] = np.mean([model.vectors[b].astype(np.float64) for b in buckets.tolist()], axis=0)
        return vectors[word]

    far = 0
    for r in docs.collect():
        words = (r.text or "").split()
        words = [quality.REPEAT if k and w == words[k - 1] else w for k, w in enumerate(words)]
        hidden = np.mean([vector(w) for w in words], axis=0) if words else np.zeros(model.vectors.shape[1])
        z = model.layer.astype(np.float64) @ hidden + model.bias
        softmax = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id] == pytest.approx(softmax[1], abs=1e-4), r.doc_id
        far += abs(softmax[1] - 0.5) > 0.4
    assert far > 50


def test_pipeline_on_odd_and_empty_tables(spark, odd):
    """Null, empty, blank, very long and repeated rows, names that clash with the stages' own, no ``n_chars``, no rows."""
    import tempfile

    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "score", "h", "words"]
    made = odd.withColumn("h", F.lit("x")).withColumn("words", F.lit(3)).select(*columns)
    bench = spark.createDataFrame([(1, "the same text again and again and so on"), (2, None), (None, "x")], "item_id long, text string")
    for rows in (made, made.limit(0)):
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        rows.write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == columns, name
        got = corpus_pipeline.run(spark, at)
        ids = [r.doc_id for r in got.collect()]
        kept = set(ids)
        assert kept <= {1, 2, 3, 4, 5, 6, 7, None} and not kept & {1, 2, 3}  # without a letter no language
        if rows is not made:
            assert ids == []


def test_bitmaps_grow_with_what_they_hold(spark, monkeypatch):
    keys = spark.range(3000).select(F.xxhash64("id").alias("g"))
    own = np.array([r.g for r in keys.collect()], dtype=np.int64).view(np.uint64)
    others = np.array([r.g for r in spark.range(10**6, 10**6 + 3000).select(F.xxhash64("id").alias("g")).collect()], dtype=np.int64).view(np.uint64)
    for least, most, size in ((1 << 10, 1 << 28, 1 << 16), (1 << 10, 1 << 15, 1 << 15), (1 << 20, 1 << 28, 1 << 20)):
        monkeypatch.setattr(decontaminate, "FILTER_BITS", least)
        monkeypatch.setattr(decontaminate, "MOST_BITS", most)
        bits = decontaminate.sized_filter(keys)
        assert 8 * len(bits) == size and len(decontaminate.places(own, bits)) == 3000
        assert len(decontaminate.places(others, bits)) < 3000 * 3000 / size * 1.5 + 20
    assert not len(decontaminate.places(own, decontaminate.sized_filter(keys.limit(0))))


def test_search_over_a_grid_of_groups(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(rng.choice([3, 4]))]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = {k: [np.floor(64 * x) for x in v] for k, v in rows}
    want = []
    for a in range(0, 400, 20):
        scored = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:6]
        want += [(a, r, b, -s) for r, (s, b) in enumerate(scored, 1)]
    for held in (1, 3, 8):
        monkeypatch.setattr(top_k, "HELD", held)
        got = top_k.top_k(df, F.col("vec_id") % 20 == 0, k=6, query_block=3, block=16)
        assert sorted(map(tuple, got.collect())) == want
    assert top_k.grid(100, 50, 32) == (13, 3) and top_k.grid(0, 0, 32) == (1, 1) and top_k.grid(3, 2, 32) == (1, 2)  # copies: 13 of a candidate, 3 of a query
    assert top_k.top_k(df, F.lit(False), k=6).count() == 0 and top_k.top_k(df.limit(0), F.lit(True), k=6).count() == 0


@pytest.mark.parametrize("rare", [8, 0])  # n-grams that name items by themselves, and only together with a word
def test_decontamination_finds_what_aligning_all_pairs_finds(spark, monkeypatch, rare):
    """Copies with words put in, left out and changed, items of all lengths: every pair, and its score, as by brute force."""
    monkeypatch.setattr(decontaminate, "RARE", rare)
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = {k: [rng.choice(vocabulary) for _ in range(n)] for k, n in enumerate([4, 9, 17, 30, 30, 40, 64, 65, 90, 300])}
    items[20] = items[3][:15] + [rng.choice(vocabulary) for _ in range(15)]  # shares a half with another
    docs = {}
    for k, words in items.items():
        for kind in range(8):
            copy = []
            for j, w in enumerate(words):
                if kind == 1 and j % 4 == 0:
                    continue
                if kind in (2, 3) and rng.random() < (0.15, 0.3)[kind - 2]:
                    w = rng.choice(vocabulary)
                copy.append(w)
                if kind in (4, 5) and rng.random() < (0.3, 0.8)[kind - 4]:
                    copy += rng.sample(vocabulary, rng.randint(1, 2))
                if kind == 6 and not len(words) // 2 <= j < len(words) // 2 + 2:  # a word between all words but three
                    copy.append("between")
            docs[100 * k + kind] = rng.choices(vocabulary, k=rng.randint(0, 900)) + copy + rng.choices(vocabulary, k=rng.randint(0, 900))
    words_of = decontaminate.Words()
    coded = {i: words_of(" ".join(w)) for i, w in items.items()}
    want = {}
    for d, words in docs.items():
        text = words_of(" ".join(words))
        for i, item in coded.items():
            if np.isin(decontaminate.grams(text, 3), decontaminate.grams(item, 3)).any():
                score, low, high = decontaminate.align(item, text)
                inside = np.isin(decontaminate.grams(text[low:high], 3), decontaminate.grams(item, 3)).any()
                if score >= len(item) and inside:
                    want[d, i] = score / 2 / len(item)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(table, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 60
    assert (306, 3) in got and got[306, 3] < 0.56  # thirty words with one word between, and one n-gram left


def test_a_common_n_gram_names_no_pair(spark, monkeypatch):
    """Items and documents that share only a common n-gram are not aligned; a copy of an item that keeps no other one is found."""
    rows = [(k, " ".join(["what is the", *[f"i{k}n{j}" for j in range(17)]])) for k in range(60)]
    docs = [(d, " ".join([*[f"d{d}n{j}" for j in range(60)], "what is the", *[f"e{d}n{j}" for j in range(60)]])) for d in range(100)]
    kept = [w for j, w in enumerate(rows[7][1].split()) if j < 3 or j % 3]  # every third word changed: no other n-gram is left
    docs.append((500, " ".join(w if j < 3 or w in kept else f"x{j}" for j, w in enumerate(rows[7][1].split()))))
    aligned = []
    made = decontaminate.arrow_map

    def counted(df, make, schema):
        if "score double" in schema:
            aligned.append(df.count())
        return made(df, make, schema)

    monkeypatch.setattr(decontaminate, "arrow_map", counted)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"), least_score=0.45).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(500, 7)] and aligned == [1]  # of 6060 pairs


def test_pages_with_very_long_html_are_read(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("<p>abcdefgh é", k=400_000)) * 8
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", long), (3, "http://c/", "x")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages, split_bytes=100_000).collect()}
    data = long.encode()
    assert got == {1: (len(data), warc.sha1_of(data), "revisit", 2), 2: (len(data), warc.sha1_of(data), "response", None), 3: (1, warc.sha1_of(b"x"), "response", None)}


def test_search_with_clashing_columns(spark):
    rows = [(k, [float(k % 5), float(k % 3)], 1, 2, 3, "x", "y") for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int, query_id int, block string, v string")
    plain = top_k.top_k(df.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=5, query_block=2, block=7)
    assert sorted(map(tuple, top_k.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())) == sorted(map(tuple, plain.collect())) and plain.count() == 15


def test_stages_equal_plain_versions(spark, tables):
    """Languages, benchmark copies and secrets of the pipeline against row-by-row versions over the same documents."""
    import corpus_pipeline

    docs = tables("documents")
    sf = "/root/testdata/sf0.001"
    rows = docs.collect()
    kept = corpus_pipeline.identify_language(spark, docs, sf).collect()
    encoder = language_id.Encoder(language_id.fit(docs, usable=~held_out()))
    want = {r.doc_id: encoder.decide(r.text or "") for r in rows}
    assert {r.doc_id: r.lang for r in kept} == {d: lang for d, (lang, _, margin) in want.items() if lang != "und" and margin >= 0.004}

    words_of = decontaminate.Words()
    items = [words_of(r.text or "") for r in tables("benchmark").collect()]
    few = docs.where("n_chars < 3000")
    clean = {r.doc_id for r in corpus_pipeline.drop_benchmark_copies(spark, few, sf).collect()}
    for r in few.collect():
        text = words_of(r.text or "")
        held = {g for x in items for g in decontaminate.grams(x, 3).tolist()} & set(decontaminate.grams(text, 3).tolist())
        best = max((decontaminate.align(x, text)[0] / 2 / len(x) for x in items if len(x) and np.isin(x, text).sum() >= len(x) / 2), default=0) if held else 0
        assert (r.doc_id in clean) == (best < 0.5), r.doc_id

    model = secret_scan.train(docs)
    masked = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, docs, sf).collect()}
    for r in rows:
        base, added = secret_scan.find_secrets(r.text or "", model, {}, 1.0, 20.0)
        plain, at = "", 0
        for s, e in sorted((s, e) for s, _, e in base + added):
            if s >= at:
                plain += (r.text or "")[at:s] + "[SECRET]"
            at = max(at, e)
        assert masked[r.doc_id].text == plain + (r.text or "")[at:] and masked[r.doc_id].n_chars == len(masked[r.doc_id].text)


def test_language_needs_a_letter(spark):
    assert [language_id.letters_of(t) for t in ("½²", "①②", "\u0301\u0308", "Ⅷ", "12_3", "½a²")] == ["", "", "", "", "", "a"]
    train = spark.createDataFrame([(1, "the one and only text of this language", "en"), (2, "der eine und einzige text dieser sprache", "de")] * 3, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["½²", "①", "\u0301", None, "", "x½"])], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, language_id.fit(train)).collect()}
    assert [got[k] == "und" for k in range(6)] == [True] * 5 + [False]


def test_long_training_texts_are_read_over_their_whole_length(spark):
    long = spark.createDataFrame([(1, "alpha " * 9000 + "omega " * 9000, "xx"), (1, "alpha " * 9000 + "omega " * 9000, "xx")], "doc_id long, text string, lang string")
    (content,) = language_id.fit(long, dictionary_bytes=4096).dictionaries.values()
    assert b"alpha" in content and b"omega" in content and len(content) <= 4096


def test_archive_ranges_are_dealt_to_many_tasks(spark):
    rows = [(k, "http://a/", "".join(random.Random(k).choices("abcdefghij", k=20_000))) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_and_read(pages, split_bytes=20_000)
    assert got.rdd.getNumPartitions() >= 8 and got.where(F.col("record_type") == "response").count() == 60


def test_added_secret_spans_on_strings_held_out_of_training(spark):
    """Random strings are found, ordinary identifiers are not; training sees other ones."""
    rng = random.Random(12)
    parts = "user name count index parse file reader default handler request value config session update table index_key http server client order total price list".split()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(24, 44)))
    name = lambda: rng.choice(["_", "", "-"]).join(rng.sample(parts, rng.randint(3, 6)))
    train = [(k, f"password = {secret()} " + " ".join(name() for _ in range(40))) for k in range(150)]
    model = secret_scan.train(spark.createDataFrame(train, "doc_id long, text string"))
    new_secrets, new_names = [secret() for _ in range(400)], [name() for _ in range(400)]
    found = [bool(secret_scan.find_secrets(f"see {t} here", model, {}, 1.0, 20.0)[1]) for t in new_secrets + new_names]
    recall, wrong = np.mean(found[:400]), np.mean(found[400:])
    assert recall >= 0.9 and wrong <= 0.01, (recall, wrong)
    text = " ".join(f"token={t} {u}" for t, u in zip(new_secrets, reversed(new_secrets)))
    base, added = secret_scan.find_secrets(text, model, {}, 1.0, 20.0)
    assert len(base) == 400 and not any(s < e2 and s2 < e for s, _, e in base for s2, _, e2 in added) and len(added) >= 0.9 * 400
