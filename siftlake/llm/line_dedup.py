"""Line dedup: two Bloom filters for lines seen once and twice, then an exact count of the suspected lines.

1. Tasks put the hash of each line, once a document, into a filter of lines seen once; a cell that is met again is set in a filter of lines
   seen twice. Spark merges the tasks' filters segment by segment: cells that two tasks set are seen twice. The filters are sized by the
   number of lines, up to ``MOST_CELLS``; the merged second filter (at most 32 MB) is what tasks get.
2. Lines that the second filter holds are suspected. Only they shuffle: first as hashes, counted in the task; of those in
   ``least_docs`` documents or more the texts, which confirms them exactly and finds each one's first occurrence.
3. Confirmed lines are dropped. Tasks know them by hash (by text where two texts share a hash): as one array while they are at most
   ``few``, else by a join with the documents.

From about 2^28 lines on the filters hold most cells and pass most lines. Results stay the same; what then shuffles is at most
one hash for each line of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_map, arrow_schema, stored

LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 28
SEGMENT = 1 << 16
CELLS_PER_LINE = 16
#: A task passes its filter on at so many hashes.
MOST_HASHES = 500_000


def keys_of(text: str) -> list[bytes]:
    """The lines' keys: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip().lower() for line in text.encode().split(b"\n")]


def hash_of(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


Hashed = Callable[[bytes], int]


def distinct_hashes(text: str | None, hashed: Hashed) -> np.ndarray:
    """Hashes of a document's keys that are not empty, each key once."""
    keys = set(keys_of(text or ""))
    keys.discard(b"")
    return np.fromiter(map(hashed, keys), dtype=np.int64, count=len(keys))


def places(hashes: np.ndarray, cells: int, times: int) -> np.ndarray:
    """The filter's cells of each hash, ``times`` a row."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(cells - 1) for k in range(times)], axis=1).astype(np.int64)


def filter_size(docs: DataFrame) -> tuple[int, int]:
    """Cells of each filter, a power of two, and cells a line, by the number of lines."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_LINE * lines - 1).bit_length()))
    return cells, 3 if 4 * lines <= cells else 1


def twice_seen(docs: DataFrame, cells: int, times: int, hashed: Hashed) -> np.ndarray:
    """The second filter, a bit a cell: every line of two documents or more has all its cells set."""
    parts_schema, merged_schema = arrow_schema("segment int, once binary, twice binary"), arrow_schema("segment int, bits binary")

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's two filters: the cells set, by segment."""

        def part(held: list[np.ndarray]) -> pa.RecordBatch:
            once, n = np.unique(places(np.concatenate(held), cells, times), return_counts=True)
            twice, bounds = once[n > 1], np.arange(0, cells + 1, SEGMENT)
            a, b = np.searchsorted(once, bounds), np.searchsorted(twice, bounds)
            full = np.flatnonzero(np.diff(a))
            once, twice = ((x % SEGMENT).astype(np.uint16) for x in (once, twice))
            columns = [full, [once[a[k] : a[k + 1]].tobytes() for k in full], [twice[b[k] : b[k + 1]].tobytes() for k in full]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, parts_schema)], schema=parts_schema)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(distinct_hashes(text.as_py(), hashed))
                size += len(held[-1])
                if size > MOST_HASHES:
                    yield part(held)
                    held, size = [], 0
        if size:
            yield part(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by segment; one segment is held."""
        at, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_pydict({"segment": [at], "bits": [np.packbits(twice).tobytes()]}, schema=merged_schema)
        for batch in batches:
            for segment, a, b in zip(*(batch.column(k) for k in range(3))):
                if segment.as_py() != at:
                    if at is not None:
                        yield done()
                    at, once, twice = segment.as_py(), np.zeros(SEGMENT, dtype=bool), np.zeros(SEGMENT, dtype=bool)
                new = np.frombuffer(a.as_py(), dtype=np.uint16)
                twice[new[once[new]]] = True
                twice[np.frombuffer(b.as_py(), dtype=np.uint16)] = True
                once[new] = True
        if at is not None:
            yield done()

    parts = docs.select("text").mapInArrow(filters, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    bits = np.zeros(cells // 8, dtype=np.uint8)
    for r in merged.collect():  # at most MOST_CELLS / 8 bytes
        bits[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def holds(bits: np.ndarray, hashes: np.ndarray, cells: int, times: int) -> np.ndarray:
    """True where all cells of a hash are set."""
    spots = places(hashes, cells, times)
    return ((bits[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1).all(axis=1)


def told(docs: DataFrame, table: DataFrame, suspects: DataFrame | None) -> tuple[DataFrame, Callable[[], list[dict]]]:
    """``docs`` with a column ``known``, the rows of ``table`` whose hash they hold; or, without ``suspects`` (``row``, ``h``), a function that gives tasks the whole table.

    A hash that many documents hold is one key of the join, which Spark's skew join splits.
    """
    row = F.struct(*table.columns)
    if suspects is not None:
        hits = suspects.join(table.hint("merge"), "h").select("row", row.alias("r")).groupBy("row").agg(F.collect_list("r").alias("known"))
        return docs.join(stored(hits, "line-hits").hint("merge"), "row", "left"), list
    sent = docs.sparkSession.sparkContext.broadcast(table.toArrow())
    nothing = F.array().cast(f"array<{table.schema.simpleString()}>")
    return docs.withColumn("known", nothing), lambda: sent.value.to_pylist()


def repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, keep_first: bool = False, few: int = 200_000, hashed: Hashed = hash_of
) -> DataFrame:
    """Each document without the lines that at least ``least_docs`` (two or more) documents hold: ``id_col``, ``n_lines``, ``n_dropped`` long, ``kept`` string.

    Lines end at \\n; a line's key is the line without ASCII white space at its ends, A-Z lower-cased; a line with an empty key
    is never dropped. A row is a document, so a repeated row or id counts again; a line counts once a document. With
    ``keep_first``, the line stays where it occurs first: at the least id (null last) and there the least line; rows that tie there all keep it.
    A null or empty text is one empty line; an empty table gives no rows; further columns are not read.
    """
    if least_docs < 2:
        raise ValueError("a line of one document is no repeat")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = docs.schema["id"].dataType.simpleString()
    cells, times = filter_size(docs)
    bits = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, cells, times, hashed))

    def suspected(text: str | None) -> np.ndarray:
        hashes = distinct_hashes(text, hashed)
        return hashes[holds(bits.value, hashes, cells, times)]

    def make_counts():
        def step(batch):
            h, n = np.unique(np.concatenate([suspected(t.as_py()) for t in batch.column(0)]), return_counts=True)
            return {"h": h, "n": n}

        return step

    counted = arrow_map(docs.select("text"), make_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = stored(counted.where(F.col("n") >= least_docs).select("h"), "line-hashes")
    suspects = None
    if often.count() > few:
        docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "line-docs")  # stored, so that a row keeps its name

        def make_suspects():
            def step(batch):
                found = [suspected(t.as_py()) for t in batch.column(1)]
                return {"row": np.repeat(np.array(batch.column(0)), [len(x) for x in found]), "h": np.concatenate(found)}

            return step

        suspects = stored(arrow_map(docs.select("row", "text"), make_suspects, "row long, h long"), "line-suspects")

    with_hashes, all_hashes = told(docs, often, suspects)

    def make_lines():
        common = {r["h"] for r in all_hashes()}

        def step(batch):
            rows: dict[bytes, list] = {}  # how many documents hold a key, and its first place
            for doc_id, text, own in zip(*(batch.column(k) for k in range(3))):
                doc_id, known, seen = doc_id.as_py(), common or {r["h"] for r in own.as_py() or ()}, set()
                for number, key in enumerate(keys_of(text.as_py() or "") if known else ()):
                    if key and key not in seen and hashed(key) in known:
                        seen.add(key)
                        here = (doc_id is None, 0 if doc_id is None else doc_id, number)
                        n, first = rows.get(key, (0, here))
                        rows[key] = [n + 1, min(first, here)]
            return {
                "h": [hashed(k) for k in rows],
                "key": [k.decode() for k in rows],
                "n": [n for n, _ in rows.values()],
                "no_id": [first[0] for _, first in rows.values()],
                "first_id": [None if first[0] else first[1] for _, first in rows.values()],
                "first_line": [first[2] for _, first in rows.values()],
            }

        return step

    held = arrow_map(with_hashes.select("id", "text", "known"), make_lines, f"h long, key string, n long, no_id boolean, first_id {id_kind}, first_line int")
    lines = stored(held.groupBy("h", "key").agg(F.sum("n").alias("n"), F.min(F.struct("no_id", "first_id", "first_line")).alias("first")), "lines")
    shared = lines.groupBy("h").agg((F.count(F.lit(1)) > 1).alias("shared"))  # two texts of one hash
    confirmed = lines.where(F.col("n") >= least_docs).join(shared.hint("merge"), "h")
    repeats = stored(confirmed.select("h", F.when(F.col("shared"), F.col("key")).alias("key"), "first.no_id", "first.first_id", "first.first_line"), "line-repeats")
    with_lines, all_lines = told(docs, repeats, suspects)

    def make_kept():
        def by_hash(rows: list[dict]) -> dict[int, list[dict]]:
            out: dict[int, list[dict]] = {}
            for r in rows:
                out.setdefault(r["h"], []).append(r)
            return out

        common = by_hash(all_lines())

        def stays(doc_id, number: int, key: bytes, known: dict[int, list[dict]]) -> bool:
            for r in known.get(hashed(key), ()) if key else ():
                if r["key"] is None or r["key"].encode() == key:
                    return keep_first and r["first_line"] == number and r["no_id"] == (doc_id is None) and r["first_id"] == doc_id
            return True

        def step(batch):
            out = {"id": batch.column(0), "n_lines": [], "n_dropped": [], "kept": []}
            for doc_id, text, own in zip(*(batch.column(k) for k in range(3))):
                doc_id, text, known = doc_id.as_py(), text.as_py() or "", common or by_hash(own.as_py() or [])
                lines = text.split("\n")
                kept = [line for number, (line, key) in enumerate(zip(lines, keys_of(text))) if stays(doc_id, number, key, known)] if known else lines
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["kept"].append("\n".join(kept))
            return out

        return step

    kept = arrow_map(with_lines.select("id", "text", "known"), make_kept, f"id {id_kind}, n_lines long, n_dropped long, kept string")
    return kept.withColumnRenamed("id", id_col)
