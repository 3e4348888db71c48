"""Links of posts: extraction, ranking, fetch logs, page evidence, listings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.functions import urls as U
from siftlake.functions.text import _quoted, strip

#: Order in which the kinds of a page are listed.
KINDS = (
    "anchor_href", "iframe_src", "frame_src", "image_src", "script_src", "link_href", "meta_refresh", "js_location", "linked_image_href", "markdown_href", "bare_url",
)
#: Where a tag's label is sought.
_LABELS = {"iframe": ("title", "name"), "frame": ("title", "name"), "img": ("alt",), "script": (), "link": ("rel",)}
_TAGS = {"iframe": ("iframe_src", "src"), "frame": ("frame_src", "src"), "img": ("image_src", "src"), "script": ("script_src", "src"), "link": ("link_href", "href")}


class _Tags(HTMLParser):
    """Collects (kind, address, label, labels of the images within) of the tags that name addresses; small helper of ``extract_links``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.anchor: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "a" and a.get("href"):
            self.anchor = ["anchor_href", a["href"], "", []]
            self.found.append(self.anchor)
        elif tag in _TAGS and a.get(_TAGS[tag][1]):
            label = next((a[x] for x in _LABELS[tag] if a.get(x)), "")
            self.found.append([_TAGS[tag][0], a[_TAGS[tag][1]], label, []])
        elif tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            _, _, target = a.get("content", "").partition("=")
            if target.strip():
                self.found.append(["meta_refresh", target.strip(" '\""), "", []])
        if tag == "img" and self.anchor is not None:
            self.anchor[3].append(a.get("alt", ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchor = None

    def handle_data(self, data: str) -> None:
        if self.anchor is not None:
            self.anchor[2] += f" {data}"


def extract_links(df: DataFrame, *, key: str, text: str, base: str | None = None, resolve_relative: bool = False) -> DataFrame:
    """``key``, ``ord``, ``kind``, ``url``, ``original_url``, ``text``: all http addresses of eleven kinds, kind by kind in the order found.

    ``text`` is the label: an anchor's text, or else its images'; ``title`` or ``name`` of a frame, ``alt`` of an image, ``rel`` of a link.
    ``url`` is the target where the address is a wrapper's, ``original_url`` the address itself.

    One pass with an HTML parser for tags; Markdown, script and bare addresses by patterns in Spark.
    Relative addresses are dropped unless ``resolve_relative`` joins them to ``base``. Null text has none.
    """
    kind = dict(df.dtypes)[key]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, html, root in zip(pdf["_k"], pdf["_t"], pdf["_b"], strict=True):
                tags = _Tags()
                tags.feed(html or "")
                for at, (name, url, label, inner) in enumerate(tags.found):
                    if resolve_relative and root:
                        try:
                            url = urljoin(root, url)
                        except ValueError:
                            continue
                    rows.append((k, at, name, url, " ".join(label.split()) or " ".join(" ".join(inner).split())))
            yield pd.DataFrame(rows, columns=[key, "at", "kind", "url", "text"])

    source = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), (F.col(base) if base else F.lit(None).cast("string")).alias("_b"))
    tags = source.mapInPandas(parse, f"{key} {kind}, at int, kind string, url string, text string")
    linked_image = r"(?i)\[!\[([^\]]*)\]\([^)]*\)\]\((https?://[^\s)]+)\)"
    markdown = r"(?i)\[([^\]]*)\]\((https?://[^\s)]+)\)"
    # Linked images are cut out before Markdown links are sought, and these before bare addresses: each counts once.
    texts = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    texts = texts.withColumn("_m", F.regexp_replace("_t", linked_image, " ")).withColumn("_p", F.regexp_replace("_m", markdown, " "))

    def found(t: Column, name: str, pattern: str, group: int, label: int | None = None) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0 if label else group))
        return F.transform(
            hits,
            lambda h, i: F.struct(
                i.cast("int").alias("at"), F.lit(name).alias("kind"), (F.regexp_extract(h, pattern, group) if label else h).alias("url"),
                (F.regexp_extract(h, pattern, label) if label else F.lit("")).alias("text"),
            ),
        )

    # Patterns of addresses outside of tags.
    made = F.concat(
        found(F.col("_t"), "js_location", r"""(?i)(?:window\.)?location(?:\.href)?(?:\s*=\s*|\.(?:replace|assign)\(\s*)['"](https?://[^'"]+)['"]""", 1),
        found(F.col("_t"), "linked_image_href", linked_image, 2, 1),
        found(F.col("_m"), "markdown_href", markdown, 2, 1),
        found(F.col("_p"), "bare_url", r"""(?i)(https?://[^\s<>"'()\[\]]+)""", 1),
    )
    other = texts.select(key, F.inline(made))
    links = tags.unionByName(other).withColumn("original_url", U.clean_url(F.col("url")))
    # In a lambda, so that the address is worked out once and not wherever the many patterns name it.
    links = links.withColumn("url", F.element_at(F.transform(F.array("original_url"), lambda c: U.unwrap_redirect(c)), 1)).where(U.is_http(F.col("url")))
    rank = F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, k)])[F.col("kind")]
    w = Window.partitionBy(key).orderBy(rank, "at")
    return links.select(key, F.row_number().over(w).alias("ord"), "kind", "url", "original_url", "text")


def exclude_self(links: DataFrame, excluded: DataFrame, url: str = "url") -> DataFrame:
    """Without links whose address (no query) is an excluded one."""
    bad = excluded.select(U.canonical_url(F.col(url)).alias("_u")).distinct()
    return links.withColumn("_u", U.canonical_url(F.col(url))).join(bad.hint("merge"), "_u", "left_anti").drop("_u")


def _ends(c: Column, endings: tuple[str, ...]) -> Column:
    return c.rlike("(?:" + "|".join(map(_quoted, endings)) + ")$")


def _has(c: Column, parts: tuple[str, ...]) -> Column:
    return c.rlike("|".join(map(_quoted, parts)))


def link_priority(df: DataFrame, *, url: str = "url", kind: str = "kind", text: str = "text") -> DataFrame:
    """``df`` with ``priority`` and ``reasons``: the first rung that holds decides (static 10, official 40, distribution 100, ...)."""
    shown = F.lower(F.concat(U.authority_of(F.col(url)), U.path_of(F.col(url))))
    label = F.lower(F.coalesce(text, F.lit("")))
    k = F.col(kind)
    static = F.array_compact(
        F.array(
            F.when(k.isin("image_src", "script_src", "link_href"), F.concat(F.lit("low_value_"), k)),
            F.when(_has(shown, fixed.STATIC_HOSTS), "static_host_hint"),
            F.when(_ends(shown, fixed.STATIC_ENDINGS), "static_file_extension"),
        )
    )
    official = U.is_official_install(F.col(url), F.col(text))
    spread = F.array_compact(
        F.array(
            F.when(_ends(shown, fixed.DOWNLOAD_ENDINGS), "download_file_extension"),
            F.when(_has(shown, fixed.DISTRIBUTION_HOSTS), "distribution_host_hint"),
            F.when(_has(shown, fixed.DISTRIBUTION_PATHS), "distribution_path_hint"),
            F.when(_has(label, fixed.DISTRIBUTION_TEXTS), "distribution_text_hint"),
        )
    )
    primary = k.isin("anchor_href", "markdown_href", "linked_image_href")
    embedded = k.isin("meta_refresh", "iframe_src", "frame_src", "js_location")
    df = df.withColumn("_s", static).withColumn("_d", spread).withColumn("_o", official)
    rung = lambda *v: (
        F.when(F.size("_s") > 0, v[0]).when(F.col("_o"), v[1]).when(F.size("_d") > 0, v[2]).when(primary, v[3]).when(embedded, v[4]).when(k == "bare_url", v[5]).otherwise(v[6])
    )
    named = lambda p: F.array(F.concat(F.lit(p), k))
    reasons = rung(
        F.col("_s"), F.array(F.lit("official_service_install_link")), F.col("_d"), named("primary_destination:"), named("redirect_or_embedded_destination:"),
        F.array(F.lit("generic_bare_url")), named("generic_url:"),
    )
    priority = rung(*[F.lit(n) for n in (10, 40, 100, 80, 70, 60, 50)])
    return df.withColumn("priority", priority).withColumn("reasons", reasons).drop("_s", "_d", "_o")


def best_links(df: DataFrame, *, key: str, most_aliases: int = 50) -> DataFrame:
    """The best link of each post and canonical address (query kept), with the other spellings as ``aliases`` in the order seen, a wrapper's
    address (``original_url``, if there is one) before its target. ``aliases_truncated_count``: those beyond ``most_aliases``."""
    df = df.withColumn("canonical_url", U.canonical_url(F.col("url"), keep_query=True))
    spellings = [F.struct("ord", F.lit(k).alias("k"), F.col(c).alias("url")) for k, c in enumerate(("original_url", "url")) if c in df.columns]
    groups = df.groupBy(key, "canonical_url").agg(
        F.min_by(F.struct("url", "kind", "text", "priority", "ord", "reasons"), F.struct(-F.col("priority"), F.col("ord"))).alias("b"),
        F.sort_array(F.flatten(F.collect_set(F.array(*spellings)))).alias("_all"),
    )
    spelt = F.array_distinct(F.transform("_all", lambda x: x["url"]))
    groups = groups.withColumn("_spelt", F.filter(spelt, lambda x: x != F.col("b.url")))
    beyond = F.greatest(F.size("_spelt") - most_aliases, F.lit(0)).cast("long")
    return groups.select(key, "canonical_url", "b.*", F.slice("_spelt", 1, most_aliases).alias("aliases"), beyond.alias("aliases_truncated_count"))


def top_links(df: DataFrame, *, key: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("priority"), F.asc("ord"))
    return df.withColumn("link_rank", F.row_number().over(w)).where(F.col("link_rank") <= n)


def link_stats(best: DataFrame, *, key: str, stored: int = 50, aliases: int = 50) -> DataFrame:
    """Counts of each post's links, from the result of ``best_links``: ``candidates`` (all of them are ranked and selected), their other spellings,
    ``raw`` and ``unique_urls`` (both together), ``stored``; and the limits that hold for candidates and for the spellings of one.
    """
    made = best.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.size("aliases") + F.col("aliases_truncated_count")).alias("aliases"))
    n, raw = F.col("candidates"), F.col("candidates") + F.col("aliases")
    return made.select(
        key, raw.alias("raw"), raw.alias("unique_urls"), n, "aliases", n.alias("selected"), n.alias("ranked"),
        F.least(n, F.lit(stored)).cast("long").alias("stored"), F.lit(stored).cast("long").alias("stored_limit"), F.lit(aliases).cast("long").alias("alias_limit"),
    )


def classify_fetches(log: DataFrame, most_redirects: int = 3, resolved: str | None = None) -> DataFrame:
    """A fetch log with ``kind``, ``fetch_status``, ``is_distribution_site`` and ``indicators``: the first step that holds decides.

    The address and the one that the fetch ended at (``final_url``) must both pass ``guard_reason``: scheme, port, host, and no literal
    address of a blocked network; ``resolved`` names a column with the addresses that the host was resolved to, if the log has them.
    """
    u, final = F.col("url"), F.coalesce("final_url", "url")
    mime = F.lower(F.trim(F.element_at(F.split(F.coalesce("content_type", F.lit("")), ";"), 1)))
    known = F.coalesce(resolved, F.array().cast("array<string>")) if resolved else F.lit(None).cast("array<string>")
    both = F.array(F.struct(u.alias("u"), known.alias("r")), F.struct(final.alias("u"), F.lit(None).cast("array<string>").alias("r")))
    log = log.withColumn("_reasons", F.transform(both, lambda x: U.guard_reason(x["u"], x["r"])))
    reason, astray = F.col("_reasons")[0], (final != u) & F.col("_reasons")[1].isNotNull()
    bad_mime = (mime != "") & ~mime.isin(*fixed.READABLE_TYPES)
    messenger, guarded, far = U.is_messenger(u), reason.isNotNull(), F.coalesce("redirects", F.lit(0)) > most_redirects
    failed = F.coalesce("http_status", F.lit(0)) >= 400
    blocked, error, file = fixed.FETCH_KINDS["blocked"], fixed.FETCH_KINDS["error"], fixed.FETCH_KINDS["file"]
    kind = (
        F.when(messenger, fixed.FETCH_KINDS["messenger"]).when(guarded | astray, blocked).when(far, error).when(bad_mime, file).when(failed, error).otherwise(fixed.FETCH_KINDS["web"])
    )
    status = (
        F.when(messenger, fixed.FETCH_STATUS["messenger"])
        .when(guarded, F.concat(F.lit(fixed.FETCH_STATUS["blocked"]), reason))
        .when(astray, fixed.FETCH_STATUS["astray"])
        .when(far, fixed.FETCH_STATUS["far"])
        .when(bad_mime, F.concat(F.lit(fixed.FETCH_STATUS["type"]), F.col("content_type")))
        .when(failed, F.concat(F.lit(fixed.FETCH_STATUS["failed"]), F.col("http_status").cast("string")))
        .otherwise(fixed.FETCH_STATUS["ok"])
    )
    log = log.withColumns({"kind": kind, "fetch_status": status})
    spread = (F.col("kind") == file) & F.startswith(mime, F.lit("application/")) & ~U.is_official_install(final)
    found = F.when(F.col("kind") == fixed.FETCH_KINDS["messenger"], F.array(F.lit(fixed.MESSENGER_INDICATOR))).when(spread, F.array(F.format_string(fixed.FILE_INDICATOR, mime)))
    return log.withColumn("is_distribution_site", spread).withColumn("indicators", F.coalesce(found, F.array().cast("array<string>"))).drop("_reasons")


def page_title(html: Column) -> Column:
    got = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(strip(F.regexp_replace(got, r"(?U)\s+", " ")), F.lit(""))


def page_text(html: Column, n: int = 4000) -> Column:
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    return F.substring(strip(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, n)


def page_evidence(df: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``page_title``, ``indicators`` and ``is_distribution_site`` of fetched pages; official install pages have none."""
    title, body = page_title(F.col(html)), page_text(F.col(html))
    df = df.withColumn("page_title", title).withColumn("_t", F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), body)))
    spread = _has(F.col("_t"), fixed.DISTRIBUTION_KEYWORDS)
    trade = _has(F.col("_t"), fixed.TRADE_KEYWORDS) | F.col("_t").rlike("|".join(fixed.TRADE_PATTERNS))
    found = F.array_compact(F.array(F.when(spread, "distribution_keyword"), F.when(trade, "trade_keyword_or_price")))
    none = F.array().cast("array<string>")
    indicators = F.when(U.is_official_install(F.col(url), F.col("page_title"), body), none).otherwise(found)
    return df.withColumn("indicators", indicators).withColumn("is_distribution_site", F.size("indicators") > 0).drop("_t")


def blocked_addresses(df: DataFrame, ip: str = "ip", blocks: tuple[str, ...] = (*fixed.BLOCKED_BLOCKS, *fixed.BLOCKED_SIX), spared: tuple[str, ...] = fixed.GLOBAL_SIX) -> DataFrame:
    """``df`` with ``blocked`` by fixed lists of networks (``urls.is_blocked_ip``). For a table of networks see ``networks.blocked_by``."""
    return df.withColumn("blocked", U.is_blocked_ip(F.col(ip), blocks, spared))


def domain_matches(df: DataFrame, domains: DataFrame, *, host: Column, key: str) -> DataFrame:
    """``key`` and ``domain`` of each listed domain the host is or is below: parent domains exploded, then an equi join."""
    parts = df.select(key, F.explode(U.suffixes_of(host)).alias("domain"))
    return parts.join(domains.select("domain").distinct().hint("merge"), "domain").select(key, "domain").distinct()


def listing_links(df: DataFrame, *, board: str = "board_url", pattern: Column) -> DataFrame:
    """Links of a listing that are posts: full address if it matches, else without query; first of each board; title or text."""
    base = F.regexp_replace("href", r"\?.*$", "")
    anchored = F.concat(F.lit("^(?:"), pattern, F.lit(")"))
    url = F.when(F.regexp("href", anchored), F.col("href")).when(F.regexp(base, anchored), base)
    made = df.withColumn("url", url).where(F.col("url").isNotNull()).withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), "text"))
    w = Window.partitionBy(board, "url").orderBy("ord")
    return made.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def board_pages(boards: DataFrame, *, url: str = "board_url", template: str = "page_template", most: str = "max_pages") -> DataFrame:
    """Each board's own address and those of its pages 2 to ``max_pages``."""
    n = F.greatest(F.coalesce(most, F.lit(1)), F.lit(1))
    pages = F.sequence(F.lit(1), n)
    address = F.when(F.col("page") == 1, F.col(url)).otherwise(F.replace(F.col(template), F.lit("{page}"), F.col("page").cast("string")))
    return boards.select("*", F.explode(pages).alias("page")).withColumn("page_url", address).where(F.col("page_url").isNotNull())


def next_page(df: DataFrame, marker: str, *, board: str = "board_url") -> DataFrame:
    """The first link of each board whose text holds the marker."""
    return df.where(F.contains("text", F.lit(marker))).groupBy(board).agg(F.min_by("href", "ord").alias("next_url"))
