"""Functions and rules on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import text as X
from siftlake.functions import urls as U
from siftlake.operators import links as L
from siftlake.operators import rules, scoring


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x int").select(column).first()[0]


def text(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalize(spark):
    assert text(spark, X.normalize_text, "ha​ck ｆｒｅｅ саt!!!!") == "hack free cat!!"
    assert text(spark, X.normalize_text, None) == ""
    assert text(spark, X.collapse_runs, "a\n\n\n\nb") == "a\n\nb"
    assert text(spark, X.strip_format, "a\U000e0041b") == "ab"
    assert text(spark, X.compact, "外 掛!+a") == "外掛a"


def test_excerpts(spark):
    assert text(spark, lambda c: X.excerpt(c, 4), "  ab  cd ") == "ab…"
    assert text(spark, lambda c: X.abbreviate(c, 6), "abcdefgh") == "abc..."
    assert text(spark, lambda c: X.preview(c, 5), " a\t b c d") == "a b c"


def test_values(spark):
    assert [text(spark, X.language_code, v) for v in ("zh-CN", "zh-tw", "en", " ", None)] == ["zh-CN", "zh-TW", "en", "ko", "ko"]
    at = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("bad",), (None,)], "t string").select(X.parse_time(F.col("t"), F.lit("2020-01-01 00:00:00")).cast("string"))
    assert [r[0] for r in at.collect()] == ["2024-01-02 03:04:05", "2020-01-01 00:00:00", "2020-01-01 00:00:00"]
    got = spark.range(1).select(X.percent_done(F.lit(5), F.lit(200)), X.percent_done(F.lit(7), F.lit(0)), X.percent_done(F.lit(9), F.lit(3))).first()
    assert tuple(got) == (2, 0, 100)
    row = spark.range(1).select(X.merge_images(F.array(F.lit("a"), F.lit(""), F.lit("b")), F.array(F.lit("b"), F.lit("c")))).first()
    assert row[0] == ["a", "b", "c"]
    v = spark.range(1).select(X.model_version(F.lit("agentic"), F.lit("v1"), F.lit("m:1"))).first()[0]
    assert v == "agentic:v1:m:1" and text(spark, X.model_of, v) == "v1" and text(spark, X.model_of, "x") is None
    assert text(spark, lambda c: X.pick_body(F.lit(""), c), "raw") == "raw"
    images = spark.range(1).select(X.filter_images(F.array(F.lit("http://a/x.png"), F.lit("data:1"), F.lit("http://b/y")), F.array(F.lit("b/")))).first()[0]
    assert images == ["http://b/y"]


def test_risk_and_severity(spark):
    rows = spark.createDataFrame([("T1", 1.0, True), ("T3", float("nan"), True), (None, 0.5, True), (None, 0.8, True), ("T1", 0.9, False)], "tier string, c double, bad boolean")
    got = rows.select(F.round(X.risk_score(F.col("tier"), F.col("c")), 4), X.severity(F.col("bad"), F.col("tier"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(1.0, "high"), (0.45, "low"), (0.5, "medium"), (0.8, "high"), (0.985, "low")]


def test_signals(spark):
    got = text(spark, X.signals, "HACK hack 텔레그램 http://x/a.exe 5만원")
    assert got["high_risk"] == ["HACK", "hack"] and got["contact"] == ["텔레그램"] and got["download"] == [".exe"] and "credential" not in got
    assert text(spark, X.signals, None) == {}


def test_lexicon_boundaries(spark):
    hit = lambda t, terms: text(spark, lambda c: X.contains_any(X.match_text(c), X.compact(X.match_text(c)), terms), t)
    assert hit("a bot!", ("bot",)) and not hit("robotics", ("bot",)) and hit("自 動", ("自動",)) and not hit("", ("bot", "핵"))


def test_scores(spark):
    rows = [
        ("ptt", "https://x/bbs/Lineage/", "外掛 telegram download", True, True),
        ("other", "https://x/b", "robot guide", False, True),
        ("52pojie", "https://x/b", "公告 macro", False, False),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "site_id string, board_url string, title string, keyword_matched boolean, has_title_keywords boolean")
    got = scoring.score_candidates(df).select("score", "priority_bucket", "reasons").collect()
    assert (got[0].score, got[0].priority_bucket) == (4 + 25 + 30 + 20 + 20 + 10 + 6, "P0")
    assert (got[1].score, got[1].priority_bucket, got[1].reasons) == (10, "P3", ["title_unmatched_sampling_candidate"])
    assert (got[2].score, got[2].priority_bucket) == (35, "P3") and got[2].reasons[0] == "source_risk:52pojie"
    assert (got[3].score, got[3].priority_bucket) == (4, "P3")


def test_content_kinds(spark):
    long = "x" * 60
    rows = [
        ("any", None, "empty"), ("any", "x" * 49, "short"), ("any", "x" * 50, "real"), ("any", long + " hCaptcha 404 Not Found", "captcha"), ("any", long + "请先登录", "auth_wall"),
        ("ptt_x", long, "unknown"), ("ptt_x", long + "作者看板標題時間", "real"), ("ptt_x", long + "作者看板標題時間[公告]", "sticky"), ("bahamut_z", long, "real"),
        ("bahamut_z", long + "官方公告", "sticky"), ("52pojie", long + "楼主", "real"), ("nga", long + "您所在的用户组 楼主", "auth_wall"), ("tieba", "百度首页贴吧" + long, "error"), ("inven_q", long + "EXP", "real"),
    ]
    df = spark.createDataFrame(rows, "site string, body string, want string")
    for r in df.select("*", rules.content_kind(F.col("body"), rules.site_family(F.col("site"))).alias("kind")).collect():
        assert r.kind == r.want, r


def test_urls(spark):
    cases = {"HTTPS://Ex.COM:443/A/?b=2&a=1#f": "https://ex.com/A", "http://x.org:8080/": "http://x.org:8080", "not a url ": "not a url"}
    for raw, want in cases.items():
        assert text(spark, U.canonical_url, raw) == want
    assert text(spark, lambda c: U.canonical_url(c, True), "http://x/p?b=2&a=1#z") == "http://x/p?a=1&b=2"
    assert text(spark, U.unwrap_redirect, "https://ref.gamer.com.tw/redir.php?url=https%3A%2F%2Fmega.nz%2Fx") == "https://mega.nz/x"
    assert text(spark, U.clean_url, " http://x.y/z。 ") == "http://x.y/z"
    assert text(spark, U.is_messenger, "https://discord.gg/abc") and not text(spark, U.is_messenger, "https://notdiscord.gg.example/")
    assert text(spark, U.policy_reason, "ftp://x/y") == "scheme" and text(spark, U.policy_reason, "http://x.y:81/") == "port" and text(spark, U.policy_reason, "http://x.y/") is None
    ids = {"ptt": ("https://p/M.123.A.4F.html", "123"), "52pojie": ("https://p/thread-1-2-3.html", "1_2_3"), "bahamut_x": ("https://p/C.php?snA=9&bsn=4", "bsn4_snA9"), "nga": ("https://p/read.php?tid=77", "77"), "z": ("https://p/a/b/", "b")}
    for site, (url, want) in ids.items():
        assert spark.range(1).select(U.post_id(F.lit(site), F.lit(url))).first()[0] == want
    assert spark.range(1).select(U.post_id(F.lit("nga"), F.lit("https://p/none"))).first()[0] is None
    assert spark.range(1).select(U.backfilled_url(F.lit("bahamut_x"), F.lit("bsn4_snA9"), F.lit(None).cast("string"))).first()[0] == "https://forum.gamer.com.tw/C.php?bsn=4&snA=9"


def test_addresses_are_split_as_by_the_standard_library(spark):
    import random
    from urllib.parse import urlsplit

    rng = random.Random(3)
    signs = [*"ab.:/?#@[]_|% \\&=1289-+~!éA\t\n^`{}", "http://", "https://", "//", "[::1]", ":80", ":99999", ":65535", "h.org", "[2001:db8::2]", "[v1.x]", "user:pw@"]
    urls = [start + "".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for start in ("", "http://", "HTTPS://u@h.org:8") for _ in range(1500)]
    c = F.col("u")
    parts = {"scheme": U.scheme_of(c), "netloc": U.authority_of(c), "path": U.path_of(c), "query": U.query_of(c), "hostname": U.host_of(c)}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(c, U.splits(c).alias("ok"), U.port_of(c).alias("port"), U.port_text(c).alias("written"), *[v.alias(k) for k, v in parts.items()])
    told = 0
    for r in df.collect():
        try:
            want = urlsplit(r.u)
        except ValueError:
            assert not r.ok, r
            continue
        assert r.ok and all(r[k] == getattr(want, k) for k in parts), (r, want)
        try:
            assert r.port == want.port and (r.written == "") == (want.port is None), r
        except ValueError:
            assert r.port is None and r.written, r
        told += 1
    assert told > 2000
    for raw, want in {"https://my_site.example.com/A/#f": "https://my_site.example.com/A", "HTTPS://A.example/x|y/?b=1#f": "https://a.example/x|y", "http://h.org:99999/": "http://h.org:99999", "http://[x/": "http://[x", "": "", None: None}.items():
        assert text(spark, U.canonical_url, raw) == want
    assert text(spark, U.is_messenger, "https://discord.gg/a|b") and text(spark, U.policy_reason, "https://my_site.example.com/A") is None
    assert text(spark, U.guard_reason, "http://169.254.169.254/latest") == "ip" and text(spark, U.guard_reason, "http://8.8.8.8/") is None and text(spark, U.guard_reason, None) == "unparsable"


def test_blocked(spark):
    want = {"10.1.2.3": True, "8.8.8.8": False, "100.64.0.1": True, "::1": True, "::ffff:127.0.0.1": True, "2001:4860::8888": False, "fe80::1": True, "x": True, None: True}
    df = spark.createDataFrame([(k,) for k in want], "ip string")
    assert {r.ip: r.blocked for r in L.blocked_addresses(df).collect()} == want


def test_extract_and_rank(spark):
    html = '<a href="https://mega.nz/f">get</a><iframe src="http://e.org/i"></iframe><img src="http://e.org/p.png"><meta http-equiv="refresh" content="0; url=http://e.org/r"> [t](https://e.org/m) [![a](http://e.org/q.png)](https://e.org/l) location.href="https://e.org/j" https://e.org/bare. <a href="/rel">r</a>'
    df = spark.createDataFrame([(1, html, "https://e.org/base"), (2, None, None)], "post_id long, text string, url string")
    got = L.extract_links(df, key="post_id", text="text", base="url").collect()
    kinds = [(r.kind, r.url) for r in got]
    assert kinds[0] == ("anchor_href", "https://mega.nz/f") and ("iframe_src", "http://e.org/i") in kinds and ("meta_refresh", "http://e.org/r") in kinds
    assert ("linked_image_href", "https://e.org/l") in kinds and ("markdown_href", "https://e.org/m") in kinds and ("js_location", "https://e.org/j") in kinds and ("bare_url", "https://e.org/bare") in kinds
    assert not any("rel" in u for _, u in kinds)
    ranked = {(r.kind, r.url): (r.priority, r.reasons) for r in L.link_priority(L.extract_links(df, key="post_id", text="text")).collect()}
    assert ranked["anchor_href", "https://mega.nz/f"] == (100, ["distribution_host_hint"]) and ranked["image_src", "http://e.org/p.png"][0] == 10
    assert ranked["iframe_src", "http://e.org/i"][0] == 70
    best = {r.canonical_url: r for r in L.best_links(L.link_priority(L.extract_links(df, key="post_id", text="text")), key="post_id").collect()}
    assert best["https://mega.nz/f"].kind == "anchor_href"
    official = spark.createDataFrame([("https://play.google.com/store/apps", "anchor_href", "install")], "url string, kind string, text string")
    assert L.link_priority(official).first().priority == 40


def test_fetch_log(spark):
    rows = [("https://discord.gg/a", None, None, 0), ("http://h.org:81/", None, None, 0), ("http://h.org/a", "text/html", 200, 9), ("http://h.org/a", "application/zip", 200, 0), ("http://h.org/a", "image/png", 200, 0), ("http://h.org/a", "text/html", 404, 0), ("http://h.org/a", "text/html; charset=x", 200, 1)]
    df = spark.createDataFrame([(*r, None) for r in rows], "url string, content_type string, http_status int, redirects int, final_url string")
    got = [(r.kind, r.is_distribution_site) for r in L.classify_fetches(df).collect()]
    assert got == [("messenger", False), ("blocked", False), ("error", False), ("file_direct_link", True), ("file_direct_link", False), ("error", False), ("web", False)]


def test_page_evidence(spark):
    rows = [("http://h.org", "<title> A \n b </title><p>1,000원</p>"), ("http://h.org", "<p>Download cheat</p>"), ("https://plaync.com/x", "<title>download</title>"), ("http://h.org", None), ("http://h.org", "<p>₩</p>")]
    got = L.page_evidence(spark.createDataFrame(rows, "url string, html string")).collect()
    assert got[0].page_title == "A b" and got[1].indicators == ["distribution_keyword"] and got[2].indicators == [] and got[3].page_title is None and not got[4].is_distribution_site
