"""Duplicates, decontamination, archives, search and the pipeline against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftlake.llm import components, decontaminate, paragraphs, simhash, top_k, warc
from siftlake.llm.common import scratch_dir


def classes(nodes, linked):
    """Least member reachable, by brute force."""
    nodes, parent = list(nodes), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(300, 300), (None, 4), (500, 400), (500, 400)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {frozenset(p) for p in links if None not in p}
    want = classes(sorted({x for p in links for x in p if x is not None}), lambda a, b: frozenset((a, b)) in pairs)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, tables, odd, empty, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_WORDS", 50)  # long texts come in parts
    for df in (tables("documents").where("doc_id < 120"), odd):
        rows = df.select("doc_id", "text").collect()
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(rows)
        fps = {}
        for r in rows:
            fps.setdefault(r.doc_id, plain_fingerprint(r.text) if len(r.text or "") < 50_000 else None)
        assert all(fps[r.doc_id] in (None, int(r.fingerprint, 16)) for r in got)
        known = {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id is not None}
        want = classes(sorted(known), lambda a, b: bin(known[a] ^ known[b]).count("1") <= 4)
        assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [3, 2048])
def test_simhash_links(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng, base, xs = random.Random(3), random.Random(8).getrandbits(64), set()
    for _ in range(40):
        v = base
        for b in rng.sample(range(64), rng.randint(0, 8)):
            v ^= 1 << b
        xs.add(v - (1 << 64) if v >> 63 else v)
    mask = (1 << 64) - 1
    # Task code is sent by value of the constant at planning time only in this process: both paths are run here.
    fps = spark.createDataFrame([(x,) for x in xs], "fp long")
    rows = fps.select(F.lit(0).cast("short").alias("entry"), "fp")
    got = simhash.near_links(fps) if dense > 3 else simhash.near_links(fps).unionAll(simhash._dense_links(rows.limit(0), 4))
    parts = {r.node: r.component for r in components.connected_components(got).collect()}
    want = classes(sorted(xs), lambda a, b: bin((a ^ b) & mask).count("1") <= 4)
    assert all(parts.get(x, x) == want[x] for x in xs)


def test_dense_links_cover_an_entry(spark):
    rng = random.Random(1)
    top = 0x0102030400000000
    xs = sorted({top | rng.getrandbits(8) | rng.getrandbits(4) << 20 for _ in range(60)})
    rows = spark.createDataFrame([(0, x) for x in xs], "entry short, fp long")
    parts = {r.node: r.component for r in components.connected_components(simhash._dense_links(rows, 4)).collect()}
    want = classes(xs, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert all(parts.get(x, x) == want[x] for x in xs)


def test_alignment():
    def plain(a, b):
        above, best = [0] * (len(b) + 1), 0
        for x in a:
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
            best, above = max(best, *row), row
        return best

    rng = random.Random(1)
    for _ in range(300):
        a, b = (np.array([rng.randint(0, 3) for _ in range(rng.randint(0, n))]) for n in (8, 14))
        score, low, high = decontaminate.align(a, b)
        assert score == plain(a, b) and (not score or plain(a, b[low:high]) == score)


def test_decontamination(spark, tables, odd, empty):
    rng = random.Random(6)
    bench = tables("benchmark")
    items = {r.item_id: r.text.split() for r in bench.collect()}
    filler = [w for r in tables("documents").where("doc_id < 20").collect() for w in r.text.split()]
    rows, want = [], set()
    for k, (item, words) in enumerate(items.items()):
        if len(words) < 20:
            continue
        edited = [rng.choice(filler) if rng.random() < 0.12 else w for w in words if rng.random() > 0.05]
        rows.append((k, " ".join([*rng.sample(filler, 40), *(words if k % 2 else edited), *rng.sample(filler, 40)])))
        want.add((k, item))
    clean = [(1000 + k, " ".join(rng.sample(filler, 150))) for k in range(30)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want & got) >= 0.95 * len(want) and not any(d >= 1000 for d, _ in got)
    assert decontaminate.decontaminated(docs, bench).where("doc_id >= 1000").count() == 30
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(odd, bench).count() == 9
    short = spark.createDataFrame([(1, "word"), (2, None), (3, "!!")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, short).collect()] == [(4, 1)]


def test_a_passage_in_most_documents_is_found(spark, tables):
    item = tables("benchmark").first()
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words before it "), F.lit(item.text)).alias("text"))
    assert decontaminate.contaminated(docs, tables("benchmark").where(F.col("item_id") == item.item_id)).count() == 60


def plain_repeats(rows, least_words=40, least_run=20):
    """The spans by brute force over all pairs of units that share a band: links, classes, islands."""
    cut, found = paragraphs.Cutter(least_words, 5), []
    for row, (key, text) in enumerate(rows):
        words = (text or "").lower().split()
        for kind, (_, starts, ends, sizes, hashes, keys, first) in enumerate(cut([text or ""])):
            for s, e, n, h, k, f in zip(starts, ends, sizes, hashes, keys, first):
                found.append({"row": row, "id": key, "start": int(s), "end": int(e), "n": int(n), "kind": kind, "h": h.tobytes(), "keys": set(k.tolist()), "set": paragraphs.shingles(words[f : f + n], 5)})
    texts = {u["h"]: u for u in reversed(found)}
    near = lambda a, b: texts[a]["kind"] == texts[b]["kind"] and texts[a]["keys"] & texts[b]["keys"] and paragraphs.jaccard(texts[a]["set"], texts[b]["set"]) >= 0.8
    root, members = classes(texts, near), {}
    for u in sorted(found, key=lambda u: (u["id"], u["row"], u["start"])):
        members.setdefault(root[u["h"]], []).append(u)
    out = []
    for group in members.values():
        for k, u in enumerate(group):
            if len(group) > 1:
                out.append((u["row"], u["start"], u["end"], u["kind"], u["n"], u["id"], group[0]["id"], len(group), k > 0))
    spans = []

    def islands(units):
        runs, reach = [], None
        for u in sorted(units, key=lambda u: u[1:3]):
            if reach is None or u[1] > reach:
                runs.append([])
            runs[-1].append(u)
            reach = max(reach or 0, u[2])
        return runs

    for row in {u[0] for u in out}:
        for run in islands(u for u in out if u[0] == row):
            if any(u[3] == 0 for u in run) or sum(u[4] for u in run) >= least_run:
                for key in {u[6::2] for u in run}:
                    for part in islands(u for u in run if u[6::2] == key):
                        spans.append((part[0][5], min(u[1] for u in part), max(u[2] for u in part), key[0], max(u[7] for u in part), key[1]))
    return sorted(spans)


def prose(rng, vocabulary, n):
    return [rng.choice(vocabulary) for _ in range(n)]


def test_passages_inside_and_across_lines(spark, odd, empty):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    passages = [prose(rng, words, 51 + k % 30) for k in range(40)]
    rows = []
    for k, p in enumerate(passages):  # inside a longer line; over several short lines; once more in other letters
        rows.append((2 * k, " ".join(prose(rng, words, 35) + p + prose(rng, words, 35))))
        lines = [p[j : j + 12] for j in range(0, len(p), 12)]
        rows.append((2 * k + 1, "\n".join(" ".join(x) for x in ([prose(rng, words, 9), *lines] if k % 2 else [*lines, prose(rng, words, 20)])).upper()))
    rows += [(100 + k, "\n".join(" ".join(prose(rng, words, 45)) for _ in range(4))) for k in range(40)]  # nothing repeats
    rows += [(200, " ".join(passages[0]) + "\n" + " ".join(passages[0])), (201, rows[0][1]), (201, rows[0][1]), (202, "of " * 300), (203, "of " * 200), (204, ""), (205, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit(1)).withColumn("row", F.lit("x"))
    got = sorted(map(tuple, paragraphs.repeated(docs).collect()))
    assert got == plain_repeats(rows)
    assert {r[0] for r in got} >= set(range(80)) | {200, 201, 202, 203} and not any(100 <= r[0] < 200 for r in got)
    assert sum(r[0] == 201 and r[5] for r in got) == 2  # the second of two equal rows goes too: both come after document 0
    cut = [tuple(r) for r in paragraphs.without_repeats(docs).select("doc_id", "text", "__gone", "row").collect()]
    texts = {r[0]: r[1] for r in cut}
    assert len(cut) == len(rows) and all(texts[k] == t for k, t in rows if 100 <= k < 200 or k in (0, 204, 205)) and all(r[2:] == (1, "x") for r in cut)
    assert all(len(texts[2 * k + 1].split()) <= len(rows[2 * k + 1][1].split()) - 20 for k in range(40)) and len(texts[203]) < 200
    assert paragraphs.repeated(empty).count() == 0 and {r.doc_id for r in paragraphs.repeated(odd).collect()} == {5}
    assert paragraphs.without_repeats(odd).count() == 9 and paragraphs.without_repeats(empty).count() == 0


def test_equal_rows_are_told_apart(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    got = sorted((r.removed, r.class_size) for r in paragraphs.repeated(docs).collect())
    assert got == [(False, 2), (True, 2)]
    assert sorted(r.text for r in paragraphs.without_repeats(docs).collect()) == ["", text]


def test_paragraph_chains_are_not_cut(spark, monkeypatch):
    """Edited copies of edited copies, and many unlike texts over one form, equal brute force: no joining link is lost."""
    monkeypatch.setattr(paragraphs, "QUERIES", 7)
    monkeypatch.setattr(paragraphs, "SMALL", 6)
    monkeypatch.setattr(paragraphs, "FEW", 4)
    monkeypatch.setattr(paragraphs, "PASSING", 20)
    rows = []
    for chain in range(12):
        words = [f"w{chain}x{k}" for k in range(60)]
        rows += [(len(rows) + k, " ".join(words)) for k in range(3)]
        for step in range(6):  # one more word changed at each step
            words = list(words)
            words[3 + 9 * step] = f"e{chain}x{step}"
            rows.append((len(rows), " ".join(words)))
    for k in range(40):
        rows.append((len(rows), " ".join(f"form{j}" if j % 20 < 14 else f"own{k}x{j}" for j in range(60))))
    rng = random.Random(4)
    base = [f"b{j}" for j in range(100)]
    for k in range(60):  # a large group on both sides of the least similarity
        rows.append((len(rows), " ".join(rng.choice("xyz") + str(k) if rng.random() < 0.03 else w for w in base)))
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == plain_repeats(rows)


def test_unlike_texts_over_one_form_grow_with_their_number(spark, monkeypatch):
    """Candidates of open collisions grow like the texts."""
    counts, compare, verify = [], paragraphs._compare, paragraphs.verified

    def counted(function):
        def call(rows, *rest):
            counts[-1] += rows.count()
            return function(rows, *rest)

        return call

    monkeypatch.setattr(paragraphs, "_compare", counted(compare))
    monkeypatch.setattr(paragraphs, "verified", counted(verify))
    for n in (150, 600):
        rng, rows = random.Random(n), []
        for k in range(n):
            rows.append((" ".join(f"form{j}" if j % 20 < 14 else f"own{rng.randrange(20 * n)}" for j in range(60)),))
        texts = spark.createDataFrame(rows, "words string").withColumn("h", F.unhex(F.md5("words")))
        sides = texts.select(F.lit(1).cast("long").alias("key"), F.lit(n).alias("company"), "h", F.col("h").alias("c"), F.lit(True).alias("outside"))
        counts.append(0)
        assert paragraphs.links_outside(sides, texts, size=5, similarity=0.8).count() == 0
    assert counts[1] <= 6 * max(counts[0], n), counts


def test_band_recall():
    """Lines and pieces of similarity 0.8 collide as often as the bands say."""
    rng, met = random.Random(9), {0: [], 1: []}
    for k in range(300):
        for kind, n, edits in ((0, 120, 3), (1, 0, 0)):
            size = n or 14
            a = [f"v{k}x{j}" for j in range(size)]
            b = list(a)
            for e in range(edits):
                b[rng.randint(e * 40 + 6, e * 40 + 30)] = "new"
            if kind:
                b[0] = "new"
            grams = [paragraphs.runs(paragraphs.word_hashes(" ".join(x)), 5) for x in (a, b)]
            keys = [paragraphs.least_of(g, np.array([0]), np.array([size]), 5, (paragraphs.LINE_BANDS, paragraphs.PIECE_BANDS)[kind], g[:1]) for g in grams]
            assert paragraphs.jaccard(*(paragraphs.shingles(x, 5) for x in (a, b))) >= 0.77
            met[kind].append(bool((keys[0] == keys[1]).any()))
    assert np.mean(met[0]) > 0.97 and np.mean(met[1]) > 0.93


def test_archives(spark, tables):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", big + "é"), (None, "u", big), (9, "u", big), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(map(tuple, warc.archive_and_read(pages, split_bytes=700).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i is not None and i < 9
        want.append((i, len(data), warc.sha1_of(data), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archive_ranges(spark, tmp_path):
    """Whatever the ranges, each record is read once; damage costs the damaged member alone."""
    rng = random.Random(1)
    payloads = [("é" * rng.choice([0, 5, 3000]) + "".join(rng.choice("abc\x1f\n") for _ in range(rng.choice([0, 9, 20_000])))).encode() for _ in range(60)]
    members = [warc.record("response", k, "http://x", p, warc.sha1_of(p), None) for k, p in enumerate(payloads)]
    for damaged in (None, 7):
        parts = [m if k != damaged else m[:20] + b"\xff" * 8 + m[28:] for k, m in enumerate(members)]
        data = b"".join(parts)
        (tmp_path / "f").write_bytes(data)
        where, root = warc.filesystem(str(tmp_path))
        for split in (len(data) + 1, 1000, 97):
            got = []
            with where.open_input_file(f"{root}/f") as f:
                for at in range(0, len(data), split):
                    got += [b.partition(b"\r\n\r\n")[2] for _, _, b in warc.records_in(f, len(data), at, min(at + split, len(data)))]
            assert got == [p for k, p in enumerate(payloads) if k != damaged]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.15, 8)], "x") for k in range(400)]
    rows += [(1000 + k, rows[0][1], "x") for k in range(50)]  # one vector many times
    rows += [(2001, None, "x"), (2002, [1.0, None], "x"), (2003, [float("nan")] * 8, "x"), (None, rows[1][1], "x"), (2020, [0.0] * 8, "x"), (2040, [1.0, -1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    good = [(i, np.pad(np.floor(64 * np.array(v)).astype(int), (0, 8 - len(v)))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (8192, 7):
        got = top_k.top_k(df, F.col("vec_id") % 20 == 0, k=20, query_block=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    x = np.rint(np.abs(rng.normal(0, 3, (5000, 2)))).astype(np.int64)
    x[17] = [500, 500]
    best = top_k.Best(1, 1)
    scored = top_k.search_block(np.arange(5000), x, np.array([99_999]), np.array([[3, 2]]), best)
    assert best.ids[0].tolist() == [17] and scored < 1000


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = tables("documents")
    assert scratch_dir(spark)
    out, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, out, "/root/testdata/sf0.001").cache()
        sizes.append(out.count())
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "near_dedup":  # Jaccard 0.8 of five-word shingles, as for all stages on word shingles
            sets = {r.doc_id: paragraphs.shingles((r.text or "").lower().split(), 5) for r in before.collect()}
            want = classes(sorted(sets), lambda a, b: paragraphs.jaccard(sets[a], sets[b]) >= 0.8)
            assert {r.doc_id for r in out.collect()} == set(want.values())
        if name == "secret_scan":
            assert out.where(F.col("text").rlike("AKIA[A-Z0-9]{12,}")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 0.95 * docs.count() and out.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == sizes[-1]
