"""Literal rows of rules, addresses, links and running sums."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftlake.functions import urls as U
from siftlake.operators import languages, links, merge, reports, rules, scoring, selection


def test_blocked_addresses(spark):
    bad = [
        "127.0.0.1", "10.1.2.3", "100.64.0.1", "169.254.169.254", "255.255.255.255", "::1", "0:0:0:0:0:0:0:1", "::", "::ffff:7f00:1", "::ffff:127.0.0.1", "0:0:0:0:0:FFFF:0a00:0001", "2001:db8::1", "fc00::1",
        "fe80::1%eth0", "ff02::1", "64:ff9b:1::1", "2002::1", "nonsense", "", None, "1::2::3", "1:2:3:4:5:6:7", "12345::", "::ffff:300.1.1.1", "1.2.3",
    ]
    good = ["8.8.8.8", "100.128.0.1", "2606:4700:4700::1111", "2a00:1450:4001:80b::200e", "::ffff:8.8.8.8", "::ffff:808:808", "2001:4860:4860:0:0:0:0:8888", "2001:20::1"]
    df = spark.createDataFrame([(a,) for a in bad + good], "ip string")
    got = {r.ip: r.blocked for r in links.blocked_addresses(df).collect()}
    assert {a for a in bad if not got[a]} == set() and {a for a in good if got[a]} == set()
    assert spark.range(1).select(U.ipv6_hex(F.lit("2001:DB8::0.1.2.3"))).first()[0] == "20010db8000000000000000000010203"


def test_links_in_markdown(spark):
    text = "[Buy now!](https://a.example/x) ![pic](https://b.example/y) [![alt!](https://c.example/i.png)](https://d.example/z) see https://e.example/w."
    got = links.extract_links(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), key="id", text="t").collect()
    assert [(r.kind, r.url, r.text) for r in sorted(got, key=lambda r: r.ord)] == [
        ("linked_image_href", "https://d.example/z", "alt!"), ("markdown_href", "https://a.example/x", "Buy now!"), ("markdown_href", "https://b.example/y", "pic"), ("bare_url", "https://e.example/w", ""),
    ]


def test_site_rules_may_be_added(spark):
    own = {"mine": lambda u: F.regexp_extract(u, "n=([0-9]+)", 1), "nga": lambda u: F.lit("replaced")}
    rows = spark.createDataFrame([("mine", "https://x/?n=7"), ("nga", "https://x/?tid=1"), ("ptt_a", "https://x/M.12.A.1F.html"), ("other", "https://x/a/b/")], "s string, u string")
    assert [r[0] for r in rows.select(U.post_id(F.col("s"), F.col("u"), own)).collect()] == ["7", "replaced", "12", "b"]
    made = spark.range(1).select(U.backfilled_url(F.lit("mine"), F.lit("7"), F.lit(None).cast("string"), {"mine": lambda p: F.concat(F.lit("https://mine/"), p)}))
    assert made.first()[0] == "https://mine/7"


def test_a_day_overrides_a_range(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = spark.createDataFrame([(k, True, 0.9, t) for k, t in enumerate([at(1), at(1, 23), at(2), at(9)])], "id int, is_illegal boolean, confidence double, detected_at timestamp_ntz")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    ids = lambda **o: sorted(r.id for r in rules.detection_filter(rows, as_of=now, **o).collect())
    assert ids(date="2024-01-01", range_="7d") == [0, 1] and ids(range_="7d", date=" ") == [3] and ids() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        ids(range_="0d")


def test_rules_are_matched_by_equal_values_where_they_have_some(spark):
    rng = random.Random(3)
    types, tiers, sites = ["a", "b", None, " "], ["T1", "T2", "T3", None, ""], ["x", "y", None, ""]
    ds = [(k, rng.choice("ab"), rng.choice(tiers[:3]), rng.choice("xyz"), rng.random()) for k in range(60)]
    rs = [(k, rng.choice(types), rng.choice(tiers), rng.choice(sites), rng.choice([None, 0.3, 0.7])) for k in range(40)]
    d = spark.createDataFrame(ds, "id int, type string, tier string, site_name string, confidence double")
    r = spark.createDataFrame(rs, "id int, detection_type string, min_tier string, source_site_name string, min_confidence double")
    free = lambda v: v is None or not v.strip()
    want = {
        (i, j) for i, t, tier, site, c in ds for j, rt, rtier, rsite, rc in rs
        if (free(rt) or t == rt) and (free(rtier) or tier <= rtier) and (free(rsite) or site == rsite) and (rc is None or c >= rc)
    }
    assert {tuple(x) for x in rules.match_rules(d, r).collect()} == want


def test_history_is_found_and_blank_bodies_are_not(spark):
    from siftlake.functions.text import content_hash
    from siftlake.operators.dedup import body_duplicates

    rows = spark.createDataFrame([(k, b) for k, b in enumerate(["old", "new", "new", "", None, " ", "other"])], "arrival long, body string")
    history = spark.createDataFrame([("old",), ("old",), ("gone",)], "b string").select(content_hash(F.col("b")).alias("body_hash")).unionAll(spark.createDataFrame([(None,)], "body_hash string"))
    assert [r.duplicate for r in body_duplicates(rows, history).orderBy("arrival").collect()] == [True, False, True, False, False, False, False]


def test_running_spend_and_latency_by_group_equal_plain_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), k, rng.randint(0, 50), rng.choice([None, 5, 7, *range(40)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "day string, n long, micro long, latency long").repartition(7)
    spent, want = {}, {}
    for d, n, m, _ in rows:
        want[n] = spent.get(d, 0)
        spent[d] = want[n] + m
    got = selection.spend_cap(df, day="day", order=["n"], micro="micro", cap=1000).collect()
    assert {r.n: (r.spent_before, r.admitted) for r in got} == {n: (s, s < 1000) for n, s in want.items()} and len(got[0]) == 6
    for r in reports.latency_summary(df, "latency", ["day"]).collect():
        v = sorted(x[3] for x in rows if x[0] == r.day and x[3] is not None)
        assert (r.n, r.median, r.p95, r.maximum) == (len(v), int((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2), v[min(len(v) - 1, len(v) * 95 // 100)], v[-1])


def test_places_and_languages(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 17).repartition(9)
    got = {r.id: r.place for r in scoring.placed(df, F.desc("k"), F.asc("id")).collect()}
    assert got == {i: p for p, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 17), i)), 1)}
    texts = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der hut und der bär", "de"), (3, "the end", None), (4, "", None), (5, None, None), (6, "😀😀😀 und der", None)], "doc_id long, text string, lang string")
    grams = texts.select("doc_id", languages.char_grams(F.col("text"))).collect()
    assert all(r[1] == [t[k : k + 3] for k in range(len(t) - 2)] for r, t in zip(grams, ["the cat and the hat", "der hut und der bär", "the end", "", "", "😀😀😀 und der"]))
    profiles = languages.language_profiles(texts.where("lang is not null"))
    found = {r.doc_id: r.language for r in languages.predict_language(texts, profiles, key="doc_id").collect()}
    assert found == {1: "en", 2: "de", 3: "en", 4: "und", 5: "und", 6: "de"}


def test_validation_reasons_and_older_types(spark):
    body = "x" * 60
    rows = spark.createDataFrame([("",), ("short",), (body + " hCaptcha Just a moment",), (body + " Access Denied",), (body + " Bad Gateway",), (body,)], "b string")
    got = [tuple(r.v) for r in rows.select(rules.content_validation(F.col("b")).alias("v")).collect()]
    assert got == [("empty", "empty body"), ("short", "body of 5 characters, least 50"), ("captcha", "marker: Just a moment"), ("auth_wall", "marker: Access Denied"), ("error", "marker: Bad Gateway"), ("real", "")]
    labels = spark.createDataFrame([("핵_배포", "핵_치트", False), ("", "기타", False), (None, "계정_거래", False), ("리세마라", "기타", True)], "type string, predicted_type string, bad boolean")
    assert {r.tier: (r.total, r.correct) for r in reports.tier_accuracy(labels, failed=F.col("bad")).collect()} == {"T1": (1, 1), "T4": (2, 1)}


def test_bucket_folds_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(200).select((F.col("id") % 2).alias("key"), F.timestamp_seconds(F.col("id")).alias("at"), "id")
        got = {r.id: r.admitted for r in merge.token_bucket(rows, tie="id", capacity=3.0, refill=0.25).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (0, 1):
        tokens, last = 3.0, None
        for i in range(k, 200, 2):
            tokens = 3.0 if last is None else min(3.0, tokens + (i - last) * 0.25)
            last = i
            assert got[i] == (tokens >= 1)
            tokens -= tokens >= 1


def test_language_scores_count_grams_in_the_batch(spark, monkeypatch):
    """Plain counts over odd texts, by both ways of the join, with short and long n-grams; no row is made for each n-gram of a text."""
    import random
    from collections import Counter

    from siftlake.operators import languages

    rng = random.Random(3)
    rows = [(k, rng.choice(["x", "y", None]), "".join(rng.choice("aAbé\x00\n𝒳 ") for _ in range(rng.choice([0, 1, 2, 5, 300])))) for k in range(60)]
    rows += [(3, "x", "aab aab"), (None, "y", "aabb"), (900, "y", None), (901, "x", "zzzzzzzz")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for n in (3, 5):
        counts, sums = {}, {}
        for _, lang, text in rows:
            low = (text or "").lower()
            counts.setdefault(lang, Counter()).update(low[p : p + n] for p in range(len(low) - n + 1))
        places = {lang: {g: p for p, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:20], 1)} for lang, c in counts.items()}
        profiles = languages.language_profiles(docs, n=n, most=20)
        assert {(r.lang, r.g, r.n, r.place) for r in profiles.collect()} == {(lang, g, counts[lang][g], p) for lang, of in places.items() for g, p in of.items()}
        for key, _, text in rows:
            low = (text or "").lower()
            for lang in ("x", "y"):
                for g in (low[p : p + n] for p in range(len(low) - n + 1)):
                    if g in places[lang] and key is not None:
                        sums[key, lang] = sums.get((key, lang), 0) + 21 - places[lang][g]
        want = {(k, *min(((-s, lang) for (d, lang), s in sums.items() if d == k), default=(0, "und"))) for k in {r[0] for r in rows}}
        for most in (100_000, 0):
            monkeypatch.setattr(languages, "BROADCAST_ROWS", most)
            got = languages.predict_language(docs, profiles, key="doc_id", n=n, most=20)
            assert {(r.doc_id, -r.score, r.language) for r in got.collect()} == want and got.count() == len(want)
            assert "Generate" not in got._jdf.queryExecution().toString()


def test_addresses_of_links_are_worked_out_once(spark):
    """Wrapped and odd addresses come out right, and the plan names the cleaning pattern a few times, not once for each pattern of hosts and queries."""
    from siftlake.operators import links

    wrapper = "https://ref.gamer.com.tw/redir.php"
    hrefs = {
        f"{wrapper}?url=https%3A%2F%2Fk.example%2Fa": "https://k.example/a", f"{wrapper}?u\trl=https%3A%2F%2Fk.example%2Fb": "https://k.example/b",
        f"{wrapper}?x=1&url=ftp%3A%2F%2Fk.example": f"{wrapper}?x=1&url=ftp%3A%2F%2Fk.example", "//ref.gamer.com.tw/redir.php?url=https%3A%2F%2Fk.example%2Fc": "https://k.example/c",
        f"{wrapper}#?url=https%3A%2F%2Fk.example": f"{wrapper}#?url=https%3A%2F%2Fk.example", "https://k.example/?url=https%3A%2F%2Fx.example": "https://k.example/?url=https%3A%2F%2Fx.example",
    }
    df = spark.createDataFrame([(k, f'<a href="{h}">x</a>') for k, h in enumerate(hrefs)], "k long, html string")
    found = links.extract_links(df, key="k", text="html")
    assert {r.k: r.url for r in found.where("kind = 'anchor_href'").collect()} == dict(enumerate(hrefs.values()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[.,;:!?") <= 8
