"""Periodic runs, source divergence and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from siftlake.llm import divergence, line_dedup, periodic_runs, queries


def plain_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """All maximal stretches, period by period."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    found = 0
    for _ in range(1500):
        n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 50])
        words = [str(rng.randint(0, kinds)) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            start, q = rng.randint(0, max(0, n - 5)), rng.randint(1, 6)
            for x in range(start + q, min(n, start + q * rng.randint(3, 7) + rng.randint(0, q))):
                words[x] = words[x - q]
        got = [tuple(r) for r in periodic_runs.runs_in(words).tolist()]
        assert got == plain_runs(words), words
        found += len(got)
    assert found > 500


def test_runs_of_long_texts():
    assert periodic_runs.runs_in(["a"] * 50_000).tolist() == [[0, 50_000, 1]]
    rng = random.Random(2)
    base = [str(rng.randint(0, 10**6)) for _ in range(7000)]
    assert periodic_runs.runs_in(["x", *base * 5, *base[:10], "y"]).tolist() == [[1, 35_010, 7000]]
    a, b = "a", "b"  # Fibonacci words are full of runs
    for _ in range(14):
        a, b = a + b, a
    assert [tuple(r) for r in periodic_runs.runs_in(list(a)[:600], 6, 4).tolist()] == plain_runs(list(a)[:600])
    with pytest.raises(ValueError):
        periodic_runs.runs_in(["a"] * 9, 4, 2)


def test_depths_of_common_ancestors():
    rng = random.Random(3)
    for n in (1, 2, 33, 200):
        letters = [rng.randint(1, 2) for _ in range(n)]
        tree = periodic_runs.SuffixTree(letters, 3)
        suffixes = [letters[k:] for k in range(n + 1)]
        assert sorted(range(n + 1), key=lambda k: suffixes[k]) == sorted(range(n + 1), key=lambda k: tree.rank[k])
        turned = [[-x for x in s] for s in suffixes]
        assert sorted(range(n + 1), key=lambda k: turned[k]) == sorted(range(n + 1), key=lambda k: tree.reverse_rank()[k])
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = (periodic_runs.np.array(x) for x in zip(*pairs))
        assert tree.common(a, b).tolist() == [common(suffixes[i], suffixes[j]) for i, j in pairs]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op11_periodic_runs(spark, sf).collect()
    assert len(rows) == len(docs)
    several = 0
    for r in rows:
        words = queries.planted_words(r.doc_id, docs[r.doc_id] or "")
        if len(words) > 1200:
            continue  # the plain version takes the square of the words
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == digest(" ".join(w for k, w in enumerate(words) if k not in gone))
        several += len(runs) > 0
    assert several > 5


def test_runs_of_odd_tables(spark, odd, empty):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].runs, by[1].collapsed) == (0, [], "") and by[3].collapsed == ""
    assert [tuple(x) for x in by[5].runs] == [(0, 320_000, 8)] and by[5].collapsed == "a b c d e f g h"
    assert by[None].collapsed == "no id here" and by[6].collapsed == "the same text again and again"
    assert periodic_runs.periodic_runs(empty).count() == 0
    assert queries.planted_words(None, "a b c") == ["a", "b", "c"] and queries.planted_words(1, "") == []


def plain_divergence(rows, least_docs=30, most_terms=50):
    """Every term of every pair of sources."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower))
        counts[lang, source].update(terms)
        held[lang].update(terms.keys())
    out = {}
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        of = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in of), Counter()))
        p = {s: shares(counts[lang, s]) for s in of}
        for s in of:
            parts = {"pair": {x: sum(abs(p[s][t] - p[x][t]) for t in kept) for x in of if x != s}, "term": {t: p[s][t] - whole[t] for t in kept if counts[lang, s][t] and p[s][t] > whole[t]}}
            for part, values in parts.items():
                order = sorted(values, key=lambda x: (-values[x], x.encode()))[: most_terms if part == "term" else None]
                out |= {(lang, s, part, x): (values[x], k) for k, x in enumerate(order, 1)}
    return out


def test_divergence(spark, tables, odd, empty):
    rng = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["É", "ß", "the-end", "x9y"]
    rows = []
    for k in range(400):
        source = rng.choice(["s1", "s2", "s3", "s4", None, "", "S1"]) if k % 3 else "s1"  # one source holds a third
        rows.append((rng.choice(["en", "de", None]), source, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights=range(1, 65), k=rng.randint(0, 30)))))
    rows += [("fr", "s1", "too few"), ("fr", "s2", None), ("it", "s9", None)] + rows[:5]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, value int")
    for kwargs in ({}, {"least_docs": 3, "most_terms": 4}):
        got = divergence.divergence(df, **kwargs).collect()
        assert {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in got} == plain_divergence(rows, **kwargs) and len(got) > 50
    docs = tables("documents")
    got = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.divergence(docs).collect()}
    assert got == plain_divergence([(r.lang, r.source, r.text) for r in docs.collect()])
    assert divergence.divergence(empty).count() == 0
    got = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.divergence(odd, least_docs=1).collect()}
    assert got == plain_divergence([(r.lang, r.source, r.text) for r in odd.collect()], least_docs=1)


def test_tree_takes_shared_paths_once(spark):
    """Rows that share a beginning, rows that begin another, equal rows by their multiplicity; in one task and in many."""
    rng = random.Random(6)
    zero = {f"s{k}": 1 + rng.randint(0, 50) for k in range(6)}
    rows = []
    for _ in range(300):
        sources = sorted(rng.sample(sorted(zero), rng.randint(1, 6)))
        rows.append((rng.choice("ab"), [(s, zero[s] + rng.randint(1, 3), zero[s]) for s in sources], rng.randint(1, 9)))
    want = Counter()
    for lang, path, times in rows:
        for k, (s, p, u) in enumerate(path):
            for t, q, v in path[:k]:
                want[lang, frozenset((s, t))] += times * (abs(p - q) - abs(p - v) - abs(u - q) + abs(u - v))
    df = spark.createDataFrame(rows, "lang string, path array<struct<source:string,p:long,zero:long>>, times long")
    for table in (df, df.coalesce(1)):
        got = Counter()
        for r in divergence.tree_corrections(table).collect():
            got[r.lang, frozenset((r.source, r.other))] += r.value
        assert got == want


def plain_lines(rows, least_docs, keep_first=False):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    held = Counter(k for _, lines in docs for k in {key(x) for x in lines} if k)
    first = {}
    for d, lines in docs:
        for n, x in enumerate(lines):
            first[key(x)] = min(first.get(key(x), (True, 0, 1 << 60)), (d is None, d or 0, n))
    out = []
    for d, lines in docs:
        kept = [x for n, x in enumerate(lines) if held[key(x)] < least_docs or keep_first and first[key(x)] == (d is None, d or 0, n)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [200_000, 0])  # told as an array, told by a join
def test_lines(spark, odd, empty, few):
    rng = random.Random(7)
    pool = ["Home | About", " home | about ", "COOKIES\t", "Ünïcode", "ünïcode", "", "  ", "a\x0bb", "x\r", "\x85x\x85", "　x", "last"]
    rows = []
    for k in range(300):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"line {rng.randint(0, 400)}" for _ in range(rng.randint(0, 12))]
        rows.append((k if k % 50 else None, "\n".join(["Common", *lines]) if k % 3 else "\n".join(lines)))
    rows += [(7, rows[7][1]), (7, rows[7][1]), (400, None), (401, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, row int")
    shape = lambda got: sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str)
    assert shape(line_dedup.repeated_lines(df, few=few)) == plain_lines(rows, 10)
    assert shape(line_dedup.repeated_lines(df, least_docs=2, keep_first=True, few=few)) == plain_lines(rows, 2, True)
    collide = lambda key: len(key) % 7  # noqa: E731  many texts to a hash: counts are by text
    assert shape(line_dedup.repeated_lines(df, few=few, hashed=collide)) == plain_lines(rows, 10)
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    assert shape(line_dedup.repeated_lines(odd, least_docs=2, few=few)) == plain_lines(plain, 2)
    assert line_dedup.repeated_lines(empty, few=few).count() == 0


def test_filters_hold_every_repeat(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(f"line {rng.randint(0, 3000)}" for _ in range(20))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    held = Counter(x.encode() for _, t in rows for x in set(t.split("\n")))
    cells, times = line_dedup.filter_size(df)
    bits = line_dedup.twice_seen(df, cells, times, line_dedup.hash_of)
    keys = list(held)
    got = line_dedup.holds(bits, periodic_runs.np.array([line_dedup.hash_of(k) for k in keys]), cells, times)
    assert all(g for g, k in zip(got, keys) if held[k] > 1)
    single = [g for g, k in zip(got, keys) if held[k] == 1]
    assert len(single) > 400 and sum(single) < 0.05 * len(single)
