"""Functions on addresses. An address is split by the generic pattern of RFC 3986, which takes any sign in a host or a path; one that
cannot be split (brackets that do not fit, a port that is no number or too great) falls to the branch each docstring names."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.functions.text import _quoted, strip


def clean_url(c: Column) -> Column:
    """Stripped, without punctuation at the end."""
    return F.regexp_replace(strip(c), "[.,;:!?。，]+$", "")


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^https?://"), F.lit(False))


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_BEFORE = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def bare(c: Column) -> Column:
    """Without what no address holds: control signs and blanks before it, tabs and line ends within."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme_of(c: Column) -> Column:
    """Lower case; empty if there is none."""
    return F.lower(F.regexp_extract(bare(c), _SCHEME, 1))


def authority_of(c: Column) -> Column:
    """What stands between ``//`` and the path; empty if there is none."""
    return F.regexp_extract(bare(c), _BEFORE + r"//([^/?#]*)", 1)


def path_of(c: Column) -> Column:
    return F.regexp_extract(bare(c), _BEFORE + r"(?://[^/?#]*)?([^?#]*)", 1)


def query_of(c: Column) -> Column:
    return F.regexp_extract(bare(c), r"(?s)^[^?#]*\?([^#]*)", 1)


def _host_port(c: Column) -> Column:
    return F.regexp_replace(authority_of(c), "(?s)^.*@", "")


def host_of(c: Column) -> Column:
    """Lower case (but for a zone, from ``%`` on), without user and port, without the brackets of an IPv6 address; null if there is none."""
    rest = _host_port(c)
    host = F.when(F.contains(rest, F.lit("[")), F.regexp_extract(rest, r"\[([^\]]*)", 1)).otherwise(F.regexp_extract(rest, "^([^:]*)", 1))
    return F.nullif(F.concat(F.lower(F.regexp_extract(host, "(?s)^([^%]*)", 1)), F.regexp_extract(host, "(?s)(%.*)$", 1)), F.lit(""))


def port_text(c: Column) -> Column:
    """The port as it is written; empty if there is none."""
    rest = _host_port(c)
    return F.when(F.contains(rest, F.lit("[")), F.regexp_extract(rest, r"(?s)^[^\[]*\[[^\]]*\][^:]*:(.*)$", 1)).otherwise(F.regexp_extract(rest, "(?s)^[^:]*:(.*)$", 1))


def port_of(c: Column) -> Column:
    """Null if there is none, or if it is no number up to 65535."""
    text = port_text(c)
    return F.when(text.rlike("^[0-9]{1,9}$") & (text.try_cast("int") <= 65535), text.try_cast("int"))


def splits(c: Column) -> Column:
    """False where brackets do not pair or hold no IPv6 address, so that nothing can be told of the address."""
    whole = authority_of(c)
    opened, closed = F.contains(whole, F.lit("[")), F.contains(whole, F.lit("]"))
    inner = F.regexp_extract(whole, r"\[([^\]]*)\]", 1)
    return F.when(opened | closed, opened & closed & (ipv6_hex(inner).isNotNull() | inner.rlike(r"^[vV][0-9A-Fa-f]+\..+"))).otherwise(c.isNotNull())


def unwrap_redirect(c: Column, hosts: tuple[str, ...] = fixed.WRAPPER_HOSTS) -> Column:
    """The target in the ``url`` parameter of a wrapper host, if it is an http address; else the address itself."""
    raw = F.nullif(F.regexp_extract(query_of(c), "(?:^|&)url=([^&]+)", 1), F.lit(""))
    target = strip(F.coalesce(F.try_url_decode(raw), raw))
    unwrapped = F.when(host_of(c).isin(*hosts) & is_http(target), target).otherwise(c)
    # Most addresses have no parameter: within a branch, the patterns of hosts and queries are not run for them.
    return F.when(F.contains(c, F.lit("?")) & F.contains(c, F.lit("=")), unwrapped).otherwise(c)


def canonical_url(c: Column, keep_query: bool = False) -> Column:
    """Scheme and host lower, default port, fragment and last slash out, query sorted or out; unparsable: stripped input without its last slashes."""
    u = strip(c)
    scheme, host, port = scheme_of(u), host_of(u), port_of(u)
    default = F.when(scheme == "http", 80).when(scheme == "https", 443)
    shown = F.when(port.isNotNull() & ~port.eqNullSafe(default), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    path, query = F.regexp_replace(path_of(u), "/+$", ""), query_of(u)
    tail = F.lit("")
    if keep_query:
        tail = F.when(query != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise("")
    made = F.concat(scheme, F.lit("://"), F.coalesce(host, F.lit("")), shown, path, tail)
    good = (scheme != "") & (authority_of(u) != "") & splits(u) & ((port_text(u) == "") | port.isNotNull())
    return F.when(good, made).otherwise(F.regexp_replace(u, "/+$", ""))


def suffixes_of(host: Column) -> Column:
    """A host and all its parent domains, for an equi join with a list of domains."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def in_domains(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of a short list of domains or below one."""
    return F.coalesce(host.rlike(r"(?:^|\.)(?:" + "|".join(map(_quoted, domains)) + r")\z"), F.lit(False))


def is_official_install(url: Column, *texts: Column) -> Column:
    """An official domain with words of installing in its host, path, query or text."""
    hay = F.lower(F.concat_ws(" ", authority_of(url), path_of(url), query_of(url), *texts))
    return in_domains(host_of(url), fixed.OFFICIAL_SUFFIXES) & hay.rlike("|".join(map(_quoted, fixed.INSTALL_HINTS)))


def is_messenger(url: Column) -> Column:
    return in_domains(host_of(url), fixed.MESSENGER_SUFFIXES)


def policy_reason(url: Column) -> Column:
    """Why an address must not be fetched: ``unparsable``, ``scheme`` (none, or another than http), ``no_host`` or ``port``; null if it may."""
    scheme, port = scheme_of(url), port_of(url)
    default = F.when(scheme == "http", 80).when(scheme == "https", 443)
    return (
        F.when(url.isNull() | (url == "") | ~splits(url), "unparsable")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host_of(url).isNull(), "no_host")
        .when((port_text(url) != "") & ~F.coalesce(port == default, F.lit(False)), "port")
    )


def _in_networks(value: Column, blocks: tuple[str, ...], version: int) -> Column:
    """Whether a number (IPv4) or 32 hex digits (IPv6, which compare as strings) lie in a network of a fixed list: range tests, no join."""
    nets = [n for n in map(ipaddress.ip_network, blocks) if n.version == version]
    shown = int if version == 4 else (lambda a: f"{int(a):032x}")
    ranges = F.array(*[F.struct(F.lit(shown(n.network_address)).alias("lo"), F.lit(shown(n.broadcast_address)).alias("hi")) for n in nets])
    return F.exists(ranges, lambda r: value.between(r["lo"], r["hi"]))


def is_blocked_ip(ip: Column, blocks: tuple[str, ...] = (*fixed.BLOCKED_BLOCKS, *fixed.BLOCKED_SIX), spared: tuple[str, ...] = fixed.GLOBAL_SIX) -> Column:
    """Whether an IPv4 number or an IPv6 address lies within a blocked network. An IPv4 address mapped into IPv6, in any
    spelling, counts as the IPv4 address; ``spared`` networks are allowed again; what is no address, and null, is blocked.
    """

    def told(x: Column) -> Column:
        digits = x["digits"]
        mapped = F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), F.conv(F.substring(digits, 25, 8), 16, 10).cast("long"))
        return _bound(
            F.coalesce(x["number"], mapped),
            lambda n: F.when(n.isNotNull(), _in_networks(n, blocks, 4)).when(digits.isNotNull(), _in_networks(digits, blocks, 6) & ~_in_networks(digits, spared, 6)).otherwise(F.lit(True)),
        )

    return _bound(F.struct(ipv4_number(ip).alias("number"), ipv6_hex(ip).alias("digits")), told)


def guard_reason(url: Column, resolved: Column | None = None) -> Column:
    """``policy_reason``, or ``ip`` for a host that is, or was resolved to (an array), a blocked address, ``dns`` where it was resolved to none.

    Null ``resolved``, or none given: nothing is known of the host's addresses.
    """

    def told(x: Column) -> Column:
        literal = ipv4_number(x["host"]).isNotNull() | F.contains(x["host"], F.lit(":"))
        addresses = F.when(literal, F.array(x["host"])).otherwise(x["resolved"])
        return F.coalesce(x["policy"], F.when(F.exists(addresses, lambda a: is_blocked_ip(a)), "ip").when(F.size(addresses) == 0, "dns"))

    known = resolved if resolved is not None else F.lit(None).cast("array<string>")
    return _bound(F.struct(policy_reason(url).alias("policy"), host_of(url).alias("host"), known.alias("resolved")), told)


def ipv4_number(c: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    good = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    parts = F.split(c, r"\.")
    numbers = [F.try_element_at(parts, F.lit(k)).try_cast("bigint") for k in (1, 2, 3, 4)]
    in_range = reduce(lambda a, b: a & b, [n <= 255 for n in numbers])
    total = reduce(lambda a, b: a * 256 + b, numbers)
    return F.when(good & in_range, total)


def post_id(site: Column, url: Column, rules: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The post id in an address by the site's rule; null where the rule does not match. Other sites: last path part.

    ``rules`` adds or replaces rules: a function of the address by the name of a site.
    """

    def part(pattern: str, group: int = 1) -> Column:
        got = F.regexp_extract(url, pattern, group)
        return F.nullif(got, F.lit(""))

    thread = F.concat_ws("_", *[part(fixed.POST_ID_THREAD, k) for k in (1, 2, 3)])
    pair = F.concat(F.lit("bsn"), part(fixed.POST_ID_BOARD), F.lit("_snA"), part(fixed.POST_ID_TOPIC))
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)
    made = reduce(lambda before, rule: F.when(site == rule[0], rule[1](url)) if before is None else before.when(site == rule[0], rule[1](url)), (rules or {}).items(), None)
    first = (lambda c, v: F.when(c, v)) if made is None else made.when
    return (
        first((site == "ptt") | F.startswith(site, F.lit("ptt_")), part(fixed.POST_ID_EPOCH))
        .when(site == "52pojie", F.nullif(thread, F.lit("")))
        .when(F.startswith(site, F.lit("bahamut")), pair)
        .when(site == "nga", part(fixed.POST_ID_NUMBER))
        .otherwise(last)
    )


def backfilled_url(site: Column, post: Column, url: Column, rules: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The stored address, or one rebuilt from site and post id; null where it cannot be rebuilt.

    ``rules`` adds or replaces rules: a function of the post id by the name of a site.
    """
    known = {name: (lambda p, start=start: F.concat(F.lit(start), p)) for name, start in fixed.POST_URLS.items()}
    known["52pojie"] = lambda p: F.concat(F.lit(fixed.THREAD_URL), F.replace(p, F.lit("_"), F.lit("-")), F.lit(".html"))
    made = F.lit(None).cast("string")
    for name, rule in (known | (rules or {})).items():
        made = F.when(site == name, rule(post)).otherwise(made)
    board = F.when(
        F.startswith(site, F.lit("bahamut_")) & post.rlike(fixed.POST_ID_PAIR),
        F.concat(F.lit(fixed.BOARD_URL), F.regexp_extract(post, fixed.POST_ID_PAIR, 1), F.lit("&snA="), F.regexp_extract(post, fixed.POST_ID_PAIR, 2)),
    )
    return F.coalesce(url, made, board)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as a function's variable, so that the plan does not copy it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ipv6_hex(c: Column) -> Column:
    """An IPv6 address as 32 hex digits, so that addresses compare as numbers; null for anything else.

    Short forms, a zone and a dotted tail are read; groups of zeros left out are put in.
    """

    def undotted(text: Column) -> Column:
        number = ipv4_number(F.regexp_extract(text, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1))
        tail = _bound(number, lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535))))
        return F.when(F.contains(text, F.lit(".")), F.lower(F.concat(F.regexp_replace(text, r"\d{1,3}(\.\d{1,3}){3}$", ""), tail))).otherwise(text)

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def padded(gs: Column) -> Column:
        return F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")

    def joined(parts: Column) -> Column:
        left, right, sides = parts["left"], parts["right"], parts["sides"]
        n = F.size(left) + F.size(right)
        full = ((sides == 1) & (n == 8)) | ((sides == 2) & (n <= 7))
        return F.when(full, F.concat(padded(left), F.repeat(F.lit("0000"), 8 - n), padded(right)))

    def read(text: Column) -> Column:
        shape = text.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$") & F.contains(text, F.lit(":"))
        sides = F.split(text, "::")
        parts = F.struct(groups(F.try_element_at(sides, F.lit(1))).alias("left"), groups(F.try_element_at(sides, F.lit(2))).alias("right"), F.size(sides).alias("sides"))
        return F.when(shape, _bound(parts, joined))

    return _bound(_bound(F.lower(F.regexp_replace(c, "%.*$", "")), undotted), read)
