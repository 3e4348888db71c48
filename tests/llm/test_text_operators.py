"""Language, quality, secrets, tokens and pieces against plain versions and held-out rows."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftlake.llm import language_id, quality, secret_scan, sentencepiece_codec, token_counts
from siftlake.llm.common import held_out

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def test_language(spark, tables, odd, empty):
    docs = tables("documents")
    model = language_id.fit(docs, usable=~held_out())
    assert set(model.dictionaries) == {"en", "de", "fr", "es"} and all(len(d) <= 65_536 for d in model.dictionaries.values())
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out()).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == 9 and {r.doc_id: r.lang_pred for r in rows}[1] == "und" and all(0 <= r.score <= 1 for r in rows)
    assert all(r.rejected for r in rows if r.lang_pred == "und")
    none = language_id.fit(empty)
    assert none.dictionaries == {} and all(r.lang_pred == "und" for r in language_id.identify(odd, none).collect())
    assert language_id.identified(odd, model).columns[:2] == ["doc_id", "text"]


def test_quality(spark, tables, odd, empty):
    docs, labels = tables("documents"), tables("labels")
    model = quality.fit(docs, labels, usable=~held_out())
    rows = quality.score(docs, model).join(labels, "doc_id").where(held_out()).collect()  # none of these was learnt from
    assert len(rows) > 5 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert len({r.score for r in quality.score(blank, model).collect()}) == 1
    twice = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text"))  # repeated rows change nothing
    assert {r.score for r in quality.score(docs, quality.fit(twice, labels, usable=~held_out())).collect()} == {r.score for r in quality.score(docs, model).collect()}
    for m in (model, quality.fit(empty, labels), quality.fit(docs, labels.where("quality = 1"))):
        got = quality.score(odd, m).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(empty, model).count() == 0


def test_quality_ignores_ids_and_labels(spark, tables):
    docs = tables("documents")
    model = quality.fit(docs, tables("labels"))
    a = quality.score(docs, model).orderBy("doc_id").collect()
    b = quality.score(docs.withColumn("lang", F.lit("x")).withColumn("doc_id", F.col("doc_id") + 1000), model).orderBy("doc_id").collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_frequent_pre_tokens_over_blocks_and_groups(spark, monkeypatch):
    """Blocks of few documents, dealt in groups: each document's sum is the library's."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(WORD)
    texts = [f"the the word{k % 7} {'x' * (k % 90)}" for k in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("n_tokens", F.lit("x")).repartition(70)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, WORD, shares=5).collect()}
    assert got == {k: len(made.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def plain_spans(text):
    """The fixed patterns, each run over the whole text by itself."""
    out = []
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def test_secrets(spark, tables, odd, empty):
    rng = random.Random(4)
    parts = ["password=", "Token : '", "api_key=", "secretſ=", "abc", "deadbeef" * 4, "AKIA" + "Z9" * 8, "AKIA", " ", "-", "é", "0123456789abcdef" * 2, "PASSWD:", "x" * 20, "\n", "kX9q2LmZ7pRt4VwB8nYs"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secret_scan.base_spans(text)[0] == plain_spans(text), text
    docs = tables("documents")
    model = secret_scan.train(docs)
    found = secret_scan.scan(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.base_spans == secret_scan.joined(plain_spans(r.text)) for r in found)
    planted = spark.createDataFrame([(1, "see kX9q2LmZ7pRt4VwB8nYsQ1 here"), (2, "internationalization_of_the_thing thereforeandhence")], "doc_id long, text string")
    assert [r.n_markov for r in secret_scan.scan(planted, model).orderBy("doc_id").collect()] == [1, 0]
    for m in (model, secret_scan.train(empty)):
        assert secret_scan.scan(odd, m).count() == 9
    masked = secret_scan.redacted(planted, model).orderBy("doc_id").collect()
    assert masked[0].text == "see [SECRET] here" and masked[1].text.startswith("inter")
    assert secret_scan.redact("abcdef", "hex:1:3,assign:2:4") == "a[SECRET]ef"


def test_token_counts(spark, tables, odd, empty):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(WORD)
    extra = spark.createDataFrame([(100, "a<|endoftext|>b's İΣΑΣ ﬁ́ 12 \x1c don't"), (101, "!" * 5000)], "doc_id long, text string")
    for df in (tables("documents").select("doc_id", "text"), odd, extra):
        want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(made.encode(r.text or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        got = token_counts.count_tokens(df, WORD, shares=3).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(empty, WORD).count() == 0


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(PIECE))


def test_pieces_against_library(codec):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(9)
    pool = [*"abcdefghijklmnopqrstuvwxyz  ABCé,.\n\t-=0123456789▁", "the", "ing", "tion", "   ", "aaaa", "====", "中", "😀", "　", "\x00"]
    for k in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        ids = model.encode(text)
        assert codec.encode(text).tolist() == ids and codec.decode(ids) == model.decode(ids)
        cuts = sorted(rng.randint(0, len(text)) for _ in range(k % 4))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert list(codec.encode_stream(iter(parts))) == ids
    long = "".join(rng.choice("abcdeftion") for _ in range(20_000))
    assert codec.encode(long).tolist() == model.encode(long)


def test_stream_keeps_a_bounded_window(codec):
    """Ids come out while the text is still being read."""
    read = []

    def parts():
        for k in range(2000):
            read.append(k)
            yield "the thing " * 3

    first = next(iter(codec.encode_stream(parts())))
    assert first >= 0 and len(read) < 10


def test_unigram_matches_full_search():
    rng = random.Random(2)
    pieces = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "ba": -4.2, "aab": -6.0, "▁a": -3.1, "abab": -7.5}
    v = sentencepiece_codec.Vocabulary({p: k for k, p in enumerate(pieces)}, pieces, (), 99, tuple(p.encode() for p in pieces), bpe=False)
    c = sentencepiece_codec.Codec(v)
    for _ in range(300):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 40)))
        best = {0: 0.0}
        norm = "▁" + text.replace(" ", "▁")
        for end in range(1, len(norm) + 1):
            best[end] = max(best[s] + pieces[norm[s:end]] for s in range(max(0, end - 4), end) if norm[s:end] in pieces)
        got = list(c.pieces_of(iter([norm[k : k + 3] for k in range(0, len(norm), 3)])))
        assert "".join(got) == norm and abs(sum(pieces[p] for p in got) - best[len(norm)]) < 1e-9


def test_encode_and_decode_tables(spark, tables, odd, empty):
    v = sentencepiece_codec.Vocabulary.load(PIECE)
    docs = tables("documents")
    coded = sentencepiece_codec.encode(docs, v)
    assert coded.where("not round_trip").count() == 0
    back = sentencepiece_codec.decode(coded, v).join(docs.select("doc_id", F.col("text").alias("want")), "doc_id")
    assert back.where("text <> want").count() == 0
    rows = sentencepiece_codec.encode(odd, v).collect()
    assert len(rows) == 9 and all(r.round_trip for r in rows) and sentencepiece_codec.encode(empty, v).count() == 0
