"""Near copies of whole documents against brute force."""

from __future__ import annotations

import random

from siftlake.llm import paragraphs


def test_pipeline_drops_near_copies_from_similarity_08(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows, sets = [], {}
    for k in range(40):
        words = [f"w{k}x{j}" for j in range(rng.randint(60, 400))]
        for step in range(5):  # edited copies of the first text and of one another, on both sides of 0.8
            rows.append((len(rows), " ".join(words)))
            sets[len(rows) - 1] = paragraphs.shingles(words, 5)
            words = list(words)
            for j in rng.sample(range(len(words)), max(1, round(len(words) * rng.choice([0.01, 0.02, 0.03])))):
                words[j] = f"e{k}x{step}x{j}"
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a - a % 5, a):
            if paragraphs.jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    rows += [(None, rows[0][1]), (1000, None), (1001, " "), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([*{root(i) for i in sets}, 1000, None], key=str)


def test_simhash_finds_a_pair_that_no_band_has(spark):
    """Jaccard 0.83, fingerprints four bits apart, and not one MinHash band in common."""
    import corpus_pipeline
    from siftlake.llm import simhash

    middle = "w88848 w214530 w549574 w605028 w836212 w436523 w405781 w688463 w554415 w36140 w309011 w131325 w561519 w55273 w778047 w293667 w937889 w4971 w33080 w418487 w542932 w9707 w102885 w781000"
    a, b = f"w877369 {middle} w591167", f"q {middle} x"
    _, keys = paragraphs.whole_texts([a, b], 5)
    assert not (keys[0] == keys[1]).any() and (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() == 4
    docs = spark.createDataFrame([(1, a), (2, b), (3, "other words"), (4, b)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_shingles_of_texts_over_one_form_are_summed_before_they_leave_a_task(spark, monkeypatch):
    form = [f"w{j}" for j in range(200)]
    rows = [(bytes([k // 256, k % 256]), " ".join([*form, f"own{k}"])) for k in range(400)]
    texts = spark.createDataFrame(rows, "h binary, words string").coalesce(1)
    made, keep = [], paragraphs.arrow_map
    monkeypatch.setattr(paragraphs, "arrow_map", lambda *a: made.append(keep(*a)) or made[-1])
    assert paragraphs.rarest(texts, size=5, similarity=0.8).count() == 400
    assert made[0].count() == 196 + 400  # not 400 texts times 197 shingles


def test_texts_of_a_large_collision_are_a_row_each_however_many_rarest_shingles_they_share(spark, monkeypatch):
    """Texts that repeat a few forms word by word in their rarest shingles: 100 texts, of which no row is made for each shared shingle."""
    rng = random.Random(5)
    forms = [[f"f{k}w{j}" for j in range(60)] for k in range(4)]
    texts, sides = [], []
    for k in range(100):
        words = [*forms[k % 4][:57], *(f"own{rng.randint(0, 2)}x{j}" for j in range(3))]
        h = bytes([k])
        texts.append((h, " ".join(words)))
        sides.append((7, 100, h, h, k > 0))
    want = {(a, b) for a, x in texts for b, y in texts if a < b and paragraphs.jaccard(paragraphs.shingles(x.split(), 5), paragraphs.shingles(y.split(), 5)) >= 0.8}
    counts, keep = {}, paragraphs.stored

    def counted(df, name):
        made = keep(df, name)
        counts[name] = made.count()
        return made

    monkeypatch.setattr(paragraphs, "stored", counted)
    links = paragraphs.links_outside(
        spark.createDataFrame(sides, "key long, company long, h binary, c binary, outside boolean"), spark.createDataFrame(texts, "h binary, words string"), size=5, similarity=0.8
    )
    found = paragraphs.connected_components(links)
    parts = {r.node[0]: r.component[0] for r in found.collect()}
    assert want and all(parts.get(a[0], a[0]) == parts.get(b[0], b[0]) for a, b in want) and len(set(parts.values())) == 4
    assert max(counts["rare-shingles"], counts["shared-shingles"]) <= 100
