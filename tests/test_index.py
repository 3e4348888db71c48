"""Networks and rules found by an index, against brute force."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.operators import links, networks, rules

RULES = "id long, min_confidence double, min_tier string, detection_type string, source_site_name string"


def test_longest_prefix(spark, monkeypatch):
    rng = random.Random(9)
    four = lambda: str(ipaddress.IPv4Address(rng.getrandbits(4) << 28 | rng.getrandbits(6)))
    six = lambda: str(ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(3) << 90 | rng.getrandbits(7)))
    nets = [f"{four()}/{rng.randint(0, 32)}" for _ in range(800)] + [f"{six()}/{rng.randint(0, 128)}" for _ in range(800)]
    nets += [four(), six(), "::ffff:10.1.2.3/120", "10.0.0.0/33", "x/8", "1.2.3.4/", "1.2.3.4/5/6", None, "::/0", " 9.9.9.0/24 "]
    ips = [four() for _ in range(300)] + [six() for _ in range(300)] + ["::ffff:10.1.2.77", "10.1.2.200", "9.9.9.9", "no", "", None, "fe80::1%eth0", "1.2.3"]
    want = []
    known = []
    for k, text in enumerate(nets):
        try:
            net = ipaddress.ip_network(text.strip(), strict=False) if text else None
            if net is not None and "ffff:" in text:
                net = ipaddress.ip_network(f"10.1.2.3/{120 - 96}", strict=False)
        except ValueError:
            net = None
        if net is not None:
            known.append((net, k, text))
    for ip in ips:
        try:
            a = ipaddress.ip_address(ip.split("%")[0])
            a = a.ipv4_mapped or a if a.version == 6 else a
        except (ValueError, AttributeError):
            a = None
        held = [(n.prefixlen, t, k) for n, k, t in known if a is not None and n.version == a.version and a in n]
        most = max((h[0] for h in held), default=None)
        want.append(min((t, k) for n, t, k in held if n == most)[1] if held else None)
    table = spark.createDataFrame([(t, k) for k, t in enumerate(nets)], "network string, k int")
    df = spark.createDataFrame(list(enumerate(ips)), "n int, ip string")
    for most in (100_000, 0):  # sent to all, joined by a shuffle
        monkeypatch.setattr(networks, "BROADCAST_ROWS", most)
        got = {r.n: r.match and r.match.k for r in networks.longest_match(df, table).collect()}
        assert [got[k] for k in range(len(ips))] == want
    assert sum(w is not None for w in want) > 400
    assert [r.match for r in networks.longest_match(df, table.limit(0)).collect()] == [None] * len(ips)
    assert networks.longest_match(df.limit(0), table).count() == 0


def test_blocked_by_a_table_is_blocked_by_the_list(spark):
    table = spark.createDataFrame([(n, True) for n in (*fixed.BLOCKED_BLOCKS, *fixed.BLOCKED_SIX)] + [(n, False) for n in fixed.GLOBAL_SIX], "network string, blocked boolean")
    rng = random.Random(10)
    edges = [ipaddress.ip_network(r[0]) for r in table.collect()]
    ips = [str(a) for n in edges for a in (n.network_address, n.broadcast_address)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    ips += [str(ipaddress.IPv6Address(0x2 << 124 | rng.getrandbits(120))) for _ in range(100)] + ["x", None, "2606:4700::1"]
    df = spark.createDataFrame(list(enumerate(ips)), "n int, ip string")
    a = {r.n: r.blocked for r in links.blocked_addresses(df).collect()}
    b = {r.n: r.blocked for r in networks.blocked_by(df, table).collect()}
    assert a == b and set(a.values()) == {True, False}


def test_rules_of_all_shapes(spark, monkeypatch):
    rng = random.Random(11)
    pick = lambda *x: rng.choice(x)
    rows = [(k, pick(None, 0.0, 0.3, 0.5, 0.5, 1.0), pick(None, "", "T1", "T2", "T3", "T4", "T9"), pick(None, " ", "a", "b"), pick(None, "", "s", "u")) for k in range(700)]
    seen = [(k, pick("a", "b", "c", None), pick("s", "u", "v", None), pick("T1", "T2", "T3", "T4", "T9", None), pick(None, 0.0, 0.3, 0.49, 0.5, 1.0)) for k in range(120)]
    blank = lambda x: not (x or "").strip()
    rank = {t: k for k, t in enumerate(fixed.TIERS)}
    want = sorted(
        (d, r)
        for d, kind, site, tier, c in seen
        for r, low, most, rkind, rsite in rows
        if (low is None or c is not None and c >= low)
        and (blank(most) or most in rank and tier in rank and rank[tier] <= rank[most])
        and (blank(rkind) or kind == rkind)
        and (blank(rsite) or site == rsite)
    )
    table = spark.createDataFrame(rows, RULES)
    df = spark.createDataFrame(seen, "id long, type string, site_name string, tier string, confidence double")
    for pack, most in ((512, 2000), (3, 0)):
        monkeypatch.setattr(rules, "PACK", pack)
        monkeypatch.setattr(rules, "BROADCAST_PACKS", most)
        assert sorted(map(tuple, rules.match_rules(df, table).collect())) == want
    assert rules.match_rules(df, table.limit(0)).count() == 0 and rules.match_rules(df.limit(0), table).count() == 0


@pytest.mark.parametrize("most", [2000, 0])
def test_a_hundred_thousand_rules_without_a_nested_loop(spark, monkeypatch, most):
    monkeypatch.setattr(rules, "BROADCAST_PACKS", most)
    table = spark.range(100_000).select("id", (F.col("id") / 100_000).alias("min_confidence"), F.lit(None).cast("string").alias("min_tier"), F.lit("").alias("detection_type"), F.lit(None).cast("string").alias("source_site_name"))
    df = spark.range(50).select("id", F.lit("a").alias("type"), F.lit("s").alias("site_name"), F.lit("T1").alias("tier"), (F.col("id") / 1000 + 0.0000001).alias("confidence"))
    got = rules.match_rules(df, table)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert {r.detection_id: r["count"] for r in got.groupBy("detection_id").count().collect()} == {k: k * 100 + 1 for k in range(50)}


def test_totals_of_rules_are_those_of_the_pairs_and_make_none(spark):
    rng = random.Random(12)
    pick = lambda *x: rng.choice(x)
    nan, levels = float("nan"), [None, 0.0, 0.3, 0.3001, 0.3002, 0.5, 1.0, -2.0, 7.0, float("nan"), float("inf")]
    rows = [(k % 590, pick(*levels), pick(None, "", "T1", "T2", "T3", "T4", "T9"), pick(None, " ", "a", "b"), pick(None, "", "s", "u")) for k in range(600)]
    seen = [(k, pick("a", "b", "c", None), pick("s", "u", "v", None), pick("T1", "T2", "T3", "T4", "T9", None), pick(*levels, 0.30015, nan)) for k in range(200)]
    table = spark.createDataFrame(rows, RULES)
    df = spark.createDataFrame(seen, "id long, type string, site_name string, tier string, confidence double")
    want = rules.match_rules(df, table).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("detection_id").alias("ids"))
    got = rules.rule_totals(df, table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema["n"].dataType == want.schema["n"].dataType
    assert rules.rule_totals(df, table.limit(0)).count() == 0 and rules.rule_totals(df.limit(0), table).count() == 0
    # 4000 rules times 4000 detections: 16 million pairs, of which the plan makes none
    many = spark.range(4000).select("id", F.lit(0.1).alias("min_confidence"), F.lit("").alias("min_tier"), F.lit("").alias("detection_type"), F.lit("").alias("source_site_name"))
    all_ = spark.range(4000).select("id", F.lit("a").alias("type"), F.lit("s").alias("site_name"), F.lit("T1").alias("tier"), (F.col("id") % 10 / 10).alias("confidence"))
    totals = rules.rule_totals(all_, many)
    assert "explode" not in totals._jdf.queryExecution().toString()
    assert [tuple(r) for r in totals.select("n", "ids").distinct().collect()] == [(3600, sum(k for k in range(4000) if k % 10))]


def test_addresses_of_pages_with_large_numbers(spark, tmp_path):
    from siftlake.plans.registry import QUERIES

    pages = [*range(30), *range(65_520, 65_560), *range(2**31 - 20, 2**31 + 20)]
    spark.createDataFrame([(p,) for p in pages], "page_id long").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.blocked for r in QUERIES["l15_j05_blocked_six"](spark, str(tmp_path)).collect()}
    assert got == {p: p % 6 != 0 for p in pages}


@pytest.mark.parametrize("ranges", [256, 3])
def test_an_address_is_not_shuffled_for_each_length(spark, monkeypatch, ranges):
    monkeypatch.setattr(networks, "RANGES", ranges)
    made, keep = [], networks._innermost
    monkeypatch.setattr(networks, "_innermost", lambda rows: made.append(rows) or keep(rows))
    nets = spark.range(33).select(F.concat(F.lit("10.1.2.3/"), "id").alias("network"), "id")
    ips = spark.range(1000).select("id", F.concat(F.lit("10.1."), F.floor(F.col("id") / 250).cast("string"), F.lit("."), (F.col("id") % 250).cast("string")).alias("ip"))
    got = {r.ip: r.match.id for r in networks.longest_match(ips, nets).collect()}
    start = int(ipaddress.ip_address("10.1.2.3"))
    assert got == {ip: 32 - (int(ipaddress.ip_address(ip)) ^ start).bit_length() for ip in got} and len(got) == 1000
    assert made[0].where("_ip is not null").count() == 1000
