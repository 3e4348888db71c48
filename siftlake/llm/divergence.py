"""Source divergence audit: how far the word shares of the sources of a language lie apart.

1. Tasks count terms and the documents that hold them; Spark sums them by language, source and term. Each language keeps the
   terms of at least ``least_docs`` of its documents. A term's row is the list of its counts above zero, by source.
2. The share of a term in a group is one plus a floor of whole numbers, so sums are exact in any order.
3. For two sources, a term that neither holds adds the distance of their shares at count zero. All terms are first taken so;
   a term that one source holds is corrected by that source's distribution of shares (``single_corrections``), and a term
   that both hold by one more correction, which comes from a frequent-pattern tree.
4. The tree: rows of terms, sources in order, equal rows once with their multiplicity, are sorted and dealt by ranges, so
   that shared beginnings meet. A task's tree is built level by level; each node adds its corrections against each
   ancestor once, times the rows that went through it.

A row holds one entry a source at most, and the result has a row for each pair of sources, so no group is larger than
what the result needs. Only the number of groups comes to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_map, arrow_schema, stored

#: All of UTF-8 beyond ASCII is a letter here, so that bytes can be searched.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: A task's counts are passed on at so many keys.
MOST_KEYS = 300_000
#: Tables of groups of up to so many rows are broadcast.
BROADCAST_ROWS = 100_000
SCALE, ADDED = 1_000_000_000, 5
#: A group's distribution of shares is dealt to so many tasks.
SALTS = 8


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``docs`` (rows that hold it); one row of a null term for each group."""
    ddl = "lang string, source string, term string, n long, docs long"
    schema = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                terms = pa.array([None, *n], pa.binary()).cast(pa.string())
                size = len(n) + 1
                columns = [pa.array([lang] * size), pa.array([source] * size), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(held[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                n, held = groups.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
                terms = TERM.findall((text.as_py() or "").encode().lower())
                size -= len(n)
                n.update(terms)
                held.update(set(terms))
                size += len(n)
                if size > MOST_KEYS:
                    yield from counted()
                    groups, size = {}, 0
        yield from counted()

    narrow = docs.select(F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col))
    return narrow.mapInArrow(count, ddl).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), in whole numbers of 38 digits; 1 where no term is kept."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")
    bottom = (total + ADDED * kept).cast("decimal(19,0)")
    return F.when(bottom > 0, F.lit(1) + F.call_function("div", top, bottom)).otherwise(F.lit(1)).cast("long")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a small stored table: broadcast behind a count, else by a shuffle."""
    few = right.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def tree_corrections(paths: DataFrame) -> DataFrame:
    """``lang, source, other, value``: corrections for terms that both sources hold, of rows ``lang, path, times``.

    A task's tree is built level by level. At each level, neighbouring rows with the same path so far are one node, whose
    rows' multiplicities are summed; the node's ancestors are the cells before it in its first row.
    """

    def make():
        def step(batch):
            cells = batch.column(1).flatten()
            begin = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            length, begin = np.diff(begin), begin[:-1]
            times = batch.column(2).to_numpy()
            p, zero = (cells.field(f).to_numpy() for f in ("p", "zero"))
            langs, sources = batch.column(0).dictionary_encode(), cells.field("source").dictionary_encode()
            lang = langs.indices.to_numpy()
            names, name = np.unique(np.repeat(lang, length).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
            sums = np.zeros(len(names) ** 2, dtype=np.int64)  # as many as the batch's languages have pairs of sources
            shared = np.concatenate([[False], lang[1:] == lang[:-1]])
            for k in range(int(length.max(initial=0))):
                has = length > k
                at = np.where(has, begin + k, 0)
                shared = shared & has & np.roll(has, 1) & (name[at] == np.roll(name[at], 1)) & (p[at] == np.roll(p[at], 1))
                first = np.flatnonzero(has & ~shared)  # the first row of each node
                through = np.add.reduceat(times[has], np.flatnonzero(~shared[has]))
                own, base = begin[first] + k, begin[first]
                for j in range(k):
                    up = base + j
                    both = np.abs(p[own] - p[up]) - np.abs(p[own] - zero[up]) - np.abs(zero[own] - p[up]) + np.abs(zero[own] - zero[up])
                    np.add.at(sums, name[up] * len(names) + name[own], both * through)
            found = np.flatnonzero(sums)
            label = [(langs.dictionary[x // len(sources.dictionary)].as_py(), sources.dictionary[x % len(sources.dictionary)].as_py()) for x in names.tolist()]
            pairs = [(label[x // len(names)], label[x % len(names)][1]) for x in found.tolist()]
            return {"lang": [a[0] for a, _ in pairs], "source": [a[1] for a, _ in pairs], "other": [b for _, b in pairs], "value": sums[found]}

        return step

    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return arrow_map(ordered.select("lang", "path", "times"), make, "lang string, source string, other string, value long")


def single_corrections(groups: DataFrame, of_lang: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, source, other, value``: over the terms that ``source`` holds, the distance of its share from the other's at zero, less that of both at zero."""

    def make():
        def step(batch):
            out = {"lang": [], "source": [], "other": [], "value": []}
            for lang, source, zero, shares, others in zip(*(batch.column(k).to_pylist() for k in range(5))):
                shares.sort(key=lambda x: x["p"])
                p = np.array([x["p"] for x in shares], dtype=np.int64)
                n = np.concatenate([[0], np.cumsum([x["times"] for x in shares])]).astype(np.int64)
                s = np.concatenate([[0], np.cumsum(p * np.diff(n))])
                bare = np.array([x["zero"] for x in others], dtype=np.int64)
                at = np.searchsorted(p, bare)
                value = bare * n[at] - s[at] + (s[-1] - s[at]) - bare * (n[-1] - n[at]) - n[-1] * np.abs(zero - bare)
                for x, v in zip(others, value.tolist()):
                    if x["source"] != source:
                        out["lang"].append(lang)
                        out["source"].append(source)
                        out["other"].append(x["source"])
                        out["value"].append(v)
            return out

        return step

    spread = cells.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    spread = spread.groupBy("lang", "source", F.pmod(F.xxhash64("p"), F.lit(SALTS)).alias("salt")).agg(F.collect_list(F.struct("p", "times")).alias("shares"))
    rows = joined(joined(spread, groups.select("lang", "source", "zero"), ["lang", "source"]), of_lang, ["lang"])
    return arrow_map(rows.select("lang", "source", "zero", "shares", "others"), make, "lang string, source string, other string, value long")


def divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, most_terms: int = 50
) -> DataFrame:
    """``lang, source, part, item, value`` long, ``rank`` int.

    Part ``pair``: for each other source of the language, the summed distances of the shares of all kept terms. Part ``term``: the
    terms whose share in the source exceeds that in the language, the first ``most_terms``. Ranks go by value, greatest first, then by item
    in the order of UTF-8. Null texts, languages and sources count as empty strings, and such groups as any other;
    an empty text only makes its group occur; a language without kept terms has pairs of value 0; a repeated row counts as
    often as it comes; an empty table gives no rows; further columns are not read.
    """
    counts = stored(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    rows = stored(
        counts.where(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs),
        "term-rows",
    )
    langs = stored(rows.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("kept")), "langs")
    flat = rows.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    groups = groups.join(totals.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left").na.fill(0)
    groups = stored(groups.withColumn("zero", share(F.lit(0), F.col("group_total"), F.col("kept"))), "groups")
    cells = stored(
        joined(flat, groups, ["lang", "source"]).select(
            "lang", "term", "source", "zero", share(F.col("n"), F.col("group_total"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_total"), F.col("kept")).alias("q")
        ),
        "term-cells",
    )

    of_lang = stored(groups.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("others")), "sources")
    bare = joined(groups, of_lang, ["lang"]).select("lang", "source", "zero", "kept", F.explode("others").alias("o"))
    bare = bare.where(F.col("o.source") != F.col("source")).select(
        "lang", "source", F.col("o.source").alias("other"), (F.col("kept") * F.abs(F.col("zero") - F.col("o.zero"))).alias("value")
    )
    paths = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path")).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    corrections = single_corrections(groups, of_lang, cells).unionByName(tree_corrections(paths))
    turned = corrections.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    pairs = bare.unionByName(corrections).unionByName(turned).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = cells.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
