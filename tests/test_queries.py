"""Each registered query against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

import datetime
import os
from decimal import Decimal

import pytest

from siftlake.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(rows, columns):
    def shown(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (float, Decimal)):
            return f"{float(v):.6g}"
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert got.columns
        return
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canon(rows, got.columns) == canon(want.fetchall(), columns)


def test_entry_lists_all_queries():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lexicon_of_odd_texts(spark, tmp_path):
    """Borders of words, characters that NFKC or lower case changes, format characters, null: as in SQL."""
    import duckdb

    texts = [
        None, "", "für", "FÜR", "bepfü reatat", "auf ürakb", "f-ür", "pfü. rund", "fu\u0308r", "f\u200bür", "\uff46ür", "f\u00adür", "f\x00ür", "tok\u200ben", "a\u200btoken", "token", "TOKEN.", "a token\n",
        "tokens", "token\u00b2", "\u2460token", "\uff54oken", "to\u212aen", "l\u0130cense", "\u0130token", "token\u0130", "pa\u017fsword", "éTokenß", "token_password", "9token token", "\U0001f600token\U0001f600",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["t08_lexicon"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {r.doc_id: r.hit for r in got} == dict(con.execute(ORACLES["t08_lexicon"]).fetchall())
    hit = {texts[r.doc_id]: r.hit for r in got}
    assert hit[None] is None and hit["für"] and not hit["bepfü reatat"] and not hit["auf ürakb"]
