"""Queries on pages and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.functions import urls as U
from siftlake.operators import links as L
from siftlake.plans.bindings import Views
from siftlake.plans.registry import query

HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
CANON = rf"lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {HOST} || regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+|[?#].*$', '', 'g'), '/+$', '')"
QUERY = r"regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.+)$', 1)"


@query("l01_l02_l04_canonical", f"SELECT page_id, {CANON} AS canonical, {CANON} || CASE WHEN {QUERY} <> '' THEN '?' || array_to_string(list_sort(string_split({QUERY}, '&')), '&') ELSE '' END AS with_query, regexp_matches(url, '^https?://') AS is_http FROM pages")
def canonical(v: Views) -> DataFrame:
    url = U.clean_url(F.col("url"))
    return v.table("pages").select("page_id", U.canonical_url(url).alias("canonical"), U.canonical_url(url, keep_query=True).alias("with_query"), U.is_http(url).alias("is_http"))


@query("t19_post_id", r"SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS post_id FROM pages")
def post_id(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", U.post_id(F.lit("other"), F.col("url")).alias("post_id"))


@query("t19_post_id_rules", r"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN page_id || '_2_3' WHEN 2 THEN 'bsn' || page_id || '_snA9' WHEN 3 THEN page_id::VARCHAR WHEN 6 THEN regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) END AS post_id FROM pages""")
def post_id_rules(v: Views) -> DataFrame:
    """Addresses of each family of sites, some without an id; others by the default rule."""
    k, n = F.col("page_id") % 7, F.col("page_id").cast("string")
    forms = (
        ("ptt", F.concat(F.lit("https://p.example/bbs/M."), n, F.lit(".A.4F.html"))), ("52pojie", F.concat(F.lit("https://p.example/thread-"), n, F.lit("-2-3.html"))), ("bahamut_x", F.concat(F.lit("https://p.example/C.php?snA=9&bsn="), n)),
        ("nga", F.concat(F.lit("https://p.example/read.php?tid="), n)), ("nga", F.lit("https://p.example/none")), ("ptt_b", F.lit("https://p.example/M.html")), ("other", F.col("url")),
    )
    site, url = F.lit(None).cast("string"), F.lit(None).cast("string")
    for j, (name, address) in enumerate(forms):
        site, url = F.when(k == j, name).otherwise(site), F.when(k == j, address).otherwise(url)
    return v.table("pages").select("page_id", U.post_id(site, url).alias("post_id"))


ABS = "(SELECT page_id, ord, regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) || href AS url, base FROM hrefs WHERE starts_with(href, '/'))"


WRAPPER = "https://ref.gamer.com.tw/redir.php?url=https%3A%2F%2Fk.example%2Fw{n}"
#: Each page with an address of every kind put in: its kind, the text, the address, whether it is a bare address too (as it stands in the text), its label.
PUT_IN = (
    ("iframe_src", '<iframe src="https://k.example/i{n}" title="t" name="no"></iframe>', "https://k.example/i{n}", True, "t"), ("frame_src", '<frame src="https://k.example/f{n}" name="side">', "https://k.example/f{n}", True, "side"),
    ("image_src", '<img src="https://k.example/p{n}.png" alt="a" title="no">', "https://k.example/p{n}.png", True, "a"), ("script_src", '<script src="https://k.example/s{n}.js"></script>', "https://k.example/s{n}.js", True, ""),
    ("link_href", '<link rel="x y" title="no" href="https://k.example/l{n}.css">', "https://k.example/l{n}.css", True, "x y"), ("meta_refresh", '<meta http-equiv="refresh" content="0; url=https://k.example/m{n}">', "https://k.example/m{n}", True, ""),
    ("anchor_href", '<a href="https://k.example/a{n}"><img alt="buy"> <img alt="it"></a>', "https://k.example/a{n}", True, "buy it"), ("anchor_href", '<a href="https://k.example/c{n}">one<b>two</b><img alt="no"></a>', "https://k.example/c{n}", True, "one two"),
    ("anchor_href", f'<a href="{WRAPPER}">w</a>', "https://k.example/w{n}", True, "w"),
    ("js_location", 'location.href = "https://k.example/j{n}"', "https://k.example/j{n}", True, ""), ("linked_image_href", " [![alt](https://k.example/b{n}.png)](https://k.example/t{n})", "https://k.example/t{n}", False, "alt"),
    ("markdown_href", " [Buy now!](https://k.example/x{n})", "https://k.example/x{n}", False, "Buy now!"), ("markdown_href", " ![pic](https://k.example/y{n})", "https://k.example/y{n}", False, "pic"), ("bare_url", " https://k.example/z{n}. ", "https://k.example/z{n}", False, ""),
)
PUT_IN_SQL = ", ".join(f"('{kind}', '{url}', '{label if kind == first else ''}')" for first, _, url, also, label in PUT_IN for kind in ((first, "bare_url") if also else (first,)))
A = """'<a href="([^"]*)">([^<]*)</a>'"""
LABELLED = rf"""(SELECT page_id, n AS ord, regexp_replace(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href, '[.,;:!?。，]+$', '') AS url, trim(replace(label, '&amp;', '&')) AS text
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {A}, 1)) AS href, unnest(regexp_extract_all(html, {A}, 2)) AS label, unnest(generate_series(1, len(regexp_extract_all(html, {A}, 1)))) AS n FROM pages) WHERE starts_with(href, '/'))"""


@query("l05_extract_links", f"""SELECT page_id, 'anchor_href' AS kind, url, url AS original_url, text FROM {LABELLED} UNION ALL
    SELECT page_id, kind, u AS url, CASE WHEN contains(u, '/w') THEN replace('{WRAPPER}', '{{n}}', page_id::VARCHAR) ELSE u END AS original_url, text FROM (SELECT page_id, kind, text, replace(k.url, '{{n}}', page_id::VARCHAR) AS u FROM pages, (VALUES {PUT_IN_SQL}) k(kind, url, text))""")
def extract(v: Views) -> DataFrame:
    put_in = F.replace(F.lit("".join(x[1] for x in PUT_IN)), F.lit("{n}"), F.col("page_id").cast("string"))
    pages = v.table("pages").select("page_id", "url", F.concat("html", put_in).alias("html"))
    return L.extract_links(pages, key="page_id", text="html", base="url", resolve_relative=True).select("page_id", "kind", "url", "original_url", "text")


@query("l05_order", f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INTEGER) AS ord, url, text FROM {LABELLED}")
def extract_order(v: Views) -> DataFrame:
    got = L.extract_links(v.table("pages"), key="page_id", text="html", base="url", resolve_relative=True)
    return got.select("page_id", "ord", "url", "text")


#: Addresses that strict parsers refuse: what is written, and its canonical form with the query, host, reason and whether it invites to a messenger.
TOLERANT = (
    ("https://my_site.example.com/A{n}/#f", "https://my_site.example.com/A{n}", "my_site.example.com", None, False), ("HTTPS://A.example/x|y{n}/?b=1#f", "https://a.example/x|y{n}?b=1", "a.example", None, False),
    ("http://h.example/a b{n}", "http://h.example/a b{n}", "h.example", None, False), ("http://h.example/[x]{n}?q=a b&c=[1]", "http://h.example/[x]{n}?c=[1]&q=a b", "h.example", None, False),
    ("http://h.example:99999/p{n}/", "http://h.example:99999/p{n}", "h.example", "port", False), ("http://[::1/p{n}", "http://[::1/p{n}", "::1", "unparsable", False),
    ("http://user:pw@H.example:80/p{n}/", "http://h.example/p{n}", "h.example", None, False), ("//h.example/p{n}/", "//h.example/p{n}", "h.example", "scheme", False), ("http:///p{n}/", "http:///p{n}", None, "no_host", False),
    ("https://discord.gg/a|b{n}", "https://discord.gg/a|b{n}", "discord.gg", None, True), ("http://[2001:DB8::1]:8080/p{n}", "http://2001:db8::1:8080/p{n}", "2001:db8::1", "port", False), ("http://h.example:x/p{n}/#y", "http://h.example:x/p{n}/#y", "h.example", "port", False),
    ("http://h.example:/p{n}^`{}", "http://h.example/p{n}^`{}", "h.example", None, False), ("page{n}/", "page{n}", None, "scheme", False),
)
TOLERANT_SQL = ", ".join("(" + ", ".join([str(k), *["NULL" if x is None else str(x) if isinstance(x, bool) else f"'{x}'" for x in r[1:]]]) + ")" for k, r in enumerate(TOLERANT))


@query("l04_l11_l12_l16_tolerant", f"""SELECT page_id, replace(canonical, '{{n}}', page_id::VARCHAR) AS canonical, host, reason, messenger FROM pages JOIN (VALUES {TOLERANT_SQL}) t(k, canonical, host, reason, messenger) ON page_id % {len(TOLERANT)} = t.k""")
def tolerant(v: Views) -> DataFrame:
    form = F.element_at(F.array(*[F.lit(r[0]) for r in TOLERANT]), (F.col("page_id") % len(TOLERANT) + 1).cast("int"))
    url = v.table("pages").select("page_id", F.replace(form, F.lit("{n}"), F.col("page_id").cast("string")).alias("u"))
    return url.select("page_id", U.canonical_url(F.col("u"), keep_query=True).alias("canonical"), U.host_of(F.col("u")).alias("host"), U.policy_reason(F.col("u")).alias("reason"), U.is_messenger(F.col("u")).alias("messenger"))


def absolute(v: Views) -> DataFrame:
    root = F.regexp_extract("base", "^([a-z]+://[^/?#]+)", 1)
    return v.hrefs.where(F.startswith("href", F.lit("/"))).select("page_id", "ord", F.concat(root, F.col("href")).alias("url"), "base", F.lit("anchor_href").alias("kind"), F.lit("").alias("text"))


@query("l06_exclude_self", f"SELECT count(*) AS n FROM {ABS} x WHERE {CANON} NOT IN (SELECT {CANON} FROM (SELECT DISTINCT url FROM {ABS} WHERE page_id % 5 = 0))", "hrefs")
def exclude_self(v: Views) -> DataFrame:
    rows = absolute(v)
    return L.exclude_self(rows, rows.where("page_id % 5 = 0").select("url")).agg(F.count(F.lit(1)).alias("n"))


BARE = r"lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://', ''))"
PRIORITY = rf"CASE WHEN regexp_matches({BARE}, '\.(avif|css|gif|ico|jpeg|jpg|js|png|svg|webp)$') THEN 10 WHEN regexp_matches({BARE}, '/download|/release|/invite|/file|t\.me') THEN 100 ELSE 80 END"


@query("l07_link_priority", f"SELECT page_id, ord, {PRIORITY} AS priority FROM (SELECT page_id, ord, CASE ord % 4 WHEN 0 THEN replace(url, '://', '://files.') WHEN 1 THEN replace(url, '://', '://download.') ELSE url END AS url FROM {ABS})", "hrefs")
def priority(v: Views) -> DataFrame:
    """Hosts that begin with a word that counts in a path only."""
    rows, k = absolute(v), F.col("ord") % 4
    hosts = F.when(k == 0, F.replace("url", F.lit("://"), F.lit("://files."))).when(k == 1, F.replace("url", F.lit("://"), F.lit("://download."))).otherwise(F.col("url"))
    return L.link_priority(rows.withColumn("url", hosts)).select("page_id", "ord", "priority")


WRAPPED = "'https://ref.gamer.com.tw/redir.php?url=' || url"
SPELT = f"""x AS (SELECT page_id, {CANON} AS canonical_url, ord, url, {PRIORITY} AS priority FROM {ABS}),
    s AS (SELECT page_id, canonical_url, ord * 2 + 1 AS pos, url FROM x UNION ALL SELECT page_id, canonical_url, ord * 2, {WRAPPED} FROM x WHERE ord % 4 = 0),
    f AS (SELECT page_id, canonical_url, url, min(pos) AS pos FROM s GROUP BY ALL),
    b AS (SELECT page_id, canonical_url, arg_min(url, (-priority, ord)) AS best, arg_min(ord, (-priority, ord)) AS ord FROM x GROUP BY ALL),
    l AS (SELECT page_id, canonical_url, b.ord, coalesce(string_agg(url, ' ' ORDER BY pos) FILTER (WHERE url <> best), '') AS aliases, count(*) FILTER (WHERE url <> best) AS n FROM f JOIN b USING (page_id, canonical_url) GROUP BY ALL)"""


def spelt(v: Views) -> DataFrame:
    """Links of pages, every fourth of which is written as a wrapper's address."""
    wrapped = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("https://ref.gamer.com.tw/redir.php?url="), "url")).otherwise(F.col("url"))
    return L.best_links(L.link_priority(absolute(v).withColumn("original_url", wrapped)), key="page_id")


@query("l08_best_links", f"SELECT page_id, canonical_url, ord, aliases FROM (WITH {SPELT} SELECT * FROM l)", "hrefs")
def best(v: Views) -> DataFrame:
    return spelt(v).select("page_id", "canonical_url", "ord", F.array_join("aliases", " ").alias("aliases"))


@query("l09_top_links", f"SELECT page_id, ord, CAST(r AS INTEGER) AS link_rank FROM (SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY {PRIORITY} DESC, ord) AS r FROM {ABS}) WHERE r <= 3", "hrefs")
def top(v: Views) -> DataFrame:
    return L.top_links(L.link_priority(absolute(v)), key="page_id", n=3).select("page_id", "ord", "link_rank")


@query("l10_link_stats", f"""SELECT page_id, n + a AS raw, n + a AS unique_urls, n AS candidates, a AS aliases, n AS selected, n AS ranked, least(n, 50) AS stored, CAST(50 AS BIGINT) AS stored_limit, CAST(50 AS BIGINT) AS alias_limit
    FROM (SELECT page_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS a FROM (WITH {SPELT} SELECT * FROM l) GROUP BY page_id)""", "hrefs")
def stats(v: Views) -> DataFrame:
    return L.link_stats(spelt(v), key="page_id")


@query("l11_l12_j06_domains", f"SELECT page_id, d.domain FROM pages JOIN (VALUES ('example.net'), ('example.com'), ('blog.tionble.example.com')) d(domain) ON {HOST} = d.domain OR ends_with({HOST}, '.' || d.domain)")
def domains(v: Views) -> DataFrame:
    listed = v.spark.createDataFrame([("example.net",), ("example.com",), ("blog.tionble.example.com",)], "domain string")
    return L.domain_matches(v.table("pages"), listed, host=U.host_of(F.col("url")), key="page_id")


@query("l14_page_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS page_title FROM pages")
def title(v: Views) -> DataFrame:
    return L.page_evidence(v.table("pages")).select("page_id", "page_title")


WORDS = r"(lower(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) || ' ' || substr(trim(regexp_replace(regexp_replace(html, '(?is)<(script)[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 4000)))"
SPREAD, TRADE = "|".join(fixed.DISTRIBUTION_KEYWORDS), "|".join((*fixed.TRADE_KEYWORDS, *fixed.TRADE_PATTERNS))


@query("l14_page_evidence", f"""SELECT page_id, list_filter([CASE WHEN regexp_matches(t, '{SPREAD}') THEN 'distribution_keyword' END, CASE WHEN regexp_matches(t, '{TRADE}') THEN 'trade_keyword_or_price' END], lambda x: x IS NOT NULL) AS indicators,
    regexp_matches(t, '{SPREAD}') OR regexp_matches(t, '{TRADE}') AS is_distribution_site FROM (SELECT page_id, {WORDS} AS t FROM pages)""")
def evidence(v: Views) -> DataFrame:
    return L.page_evidence(v.table("pages")).select("page_id", "indicators", "is_distribution_site")


@query("l15_j05_blocked", """SELECT page_id, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100)))
    OR (a = 203 AND b = 0 AND c = 113) AS blocked FROM (SELECT page_id, page_id % 256 AS a, CASE page_id % 3 WHEN 0 THEN page_id % 40 WHEN 1 THEN 64 + page_id % 190 ELSE 18 END AS b, CASE WHEN page_id % 2 = 0 THEN page_id % 7 ELSE 100 + page_id % 20 END AS c FROM pages)""")
def blocked(v: Views) -> DataFrame:
    """Addresses of all first octets; every fourth is written as an IPv4 address in IPv6, in two spellings."""
    p = F.col("page_id")
    a, b, c = p % 256, F.when(p % 3 == 0, p % 40).when(p % 3 == 1, 64 + p % 190).otherwise(18), F.when(p % 2 == 0, p % 7).otherwise(100 + p % 20)
    plain = F.concat_ws(".", *[x.cast("string") for x in (a, b, c)], F.lit("5"))
    groups = F.concat(F.lit("0:0:0:0:0:ffff:"), F.hex(a * 256 + b), F.lit(":"), F.hex(c * 256 + 5))
    ip = F.when(p % 8 == 3, F.concat(F.lit("::FFFF:"), plain)).when(p % 8 == 7, groups).otherwise(plain)
    return L.blocked_addresses(v.table("pages").select("page_id", ip.alias("ip"))).select("page_id", "blocked")


@query("l15_j05_blocked_six", """SELECT page_id, page_id % 6 <> 0 AS blocked FROM pages""")
def blocked_six(v: Views) -> DataFrame:
    """Global, documentation, unique local, link local and loopback addresses, and what is no address.

    A page's number takes two groups of 16 bits: in one, from 65,536 on, it would make no address.
    """
    n = F.concat_ws(":", *[F.lower(F.hex(F.pmod(F.shiftright("page_id", k), F.lit(65536)))) for k in (16, 0)])
    k = F.col("page_id") % 6
    ip = (
        F.when(k == 0, F.concat(F.lit("2606:4700::"), n)).when(k == 1, F.concat(F.lit("2001:DB8::"), n)).when(k == 2, F.concat(F.lit("fd00:0:0:"), n, F.lit("::1")))
        .when(k == 3, F.concat(F.lit("fe80::"), n, F.lit("%eth0"))).when(k == 4, F.lit("0:0:0:0:0:0:0:1")).otherwise(F.concat(F.lit("1:2:3:"), n))
    )
    return L.blocked_addresses(v.table("pages").select("page_id", ip.alias("ip"))).select("page_id", "blocked")


@query("l16_url_policy", r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'port' WHEN page_id % 3 = 1 THEN 'scheme' END AS reason FROM pages")
def policy(v: Views) -> DataFrame:
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.regexp_replace("url", "^([a-z]+://[^/?#]+)", "$1:8443")).when(k == 1, F.regexp_replace("url", "^[a-z]+:", "ftp:")).otherwise(F.col("url"))
    return v.table("pages").select("page_id", U.policy_reason(url).alias("reason"))


@query("l18_listing_links", "SELECT page_id, url, min(ord) AS ord FROM (SELECT page_id, regexp_replace(href, '\\?.*$', '') AS url, ord FROM hrefs WHERE regexp_matches(href, '^/[a-z]+$')) GROUP BY ALL", "hrefs")
def listing(v: Views) -> DataFrame:
    rows = v.hrefs.withColumn("title", F.lit("")).withColumn("text", F.col("href"))
    return L.listing_links(rows, board="page_id", pattern=F.lit("/[a-z]+$")).select("page_id", "url", "ord")


@query("l19_board_pages", "SELECT page_id, CAST(p AS INTEGER) AS page, CASE WHEN p = 1 THEN url ELSE url || '/p' || p END AS page_url FROM (SELECT page_id, url, unnest(generate_series(1, 1 + page_id % 3)) AS p FROM pages)")
def board_pages(v: Views) -> DataFrame:
    boards = v.table("pages").select("page_id", F.col("url").alias("board_url"), F.concat("url", F.lit("/p{page}")).alias("page_template"), (1 + F.col("page_id") % 3).cast("int").alias("max_pages"))
    return L.board_pages(boards).select("page_id", "page", "page_url")


@query("l20_next_page", "SELECT page_id, arg_min(href, ord) AS next_url FROM hrefs WHERE contains(href, 'th') GROUP BY 1", "hrefs")
def next_page(v: Views) -> DataFrame:
    return L.next_page(v.hrefs.withColumn("text", F.col("href")), "th", board="page_id")


@query("a26_link_risk", f"SELECT page_id AS detection_id, count(*) AS extracted, count(*) FILTER (ord <= 5) AS checked, count(*) FILTER (ord <= 5 AND ord % 2 = 0) AS risky FROM {ABS} GROUP BY 1", "hrefs")
def link_risk(v: Views) -> DataFrame:
    from siftlake.operators.reports import link_risk as report

    row = F.struct("ord", "url")
    per = absolute(v).groupBy(F.col("page_id").alias("detection_id")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    checked = F.transform(F.filter("r", lambda x: x["ord"] <= 5), lambda x: F.struct(x["url"].alias("url"), F.lit("web").alias("kind"), (x["ord"] % 2 == 0).alias("is_distribution_site")))
    output = F.to_json(F.struct(F.transform("r", lambda x: x["url"]).alias("extracted"), checked.alias("links")))
    got = report(per.select("detection_id", output.alias("output")))
    return got.select("detection_id", *[F.col(c).cast("bigint").alias(c) for c in ("extracted", "checked", "risky")])
