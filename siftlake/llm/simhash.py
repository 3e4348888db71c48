"""SimHash near-duplicates with a byte-position inverted index and count filtering.

A 64-bit fingerprint has eight positional bytes. Two that differ in at most four bits share at least
four of them. Lists of a single (position, byte) hold a 256th of all fingerprints each and would give pairs
by the square of the input, so the index is keyed by three of them together: its 56 lists a fingerprint are
intersections of such lists, and a linked pair meets in at least four. Within a list the shared positional bytes
of each pair are tallied; a pair is taken up only where the tally reaches the guaranteed minimum of four, in the
first list it meets in, and then verified by its Hamming distance. Only distinct fingerprints are indexed, however
many documents share them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_map, stored
from siftlake.llm.components import connected_components

BYTES = 8
CHUNK_WORDS = 200_000
#: Entries with more fingerprints than this are dealt out again, see ``_dense_links``.
DENSE = 2048


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces; of all words if they are fewer; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    text = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(text, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[i:j], seed) for i, j in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles: a bit is set if it is set in over half the hashes, repeats counted."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    total, counts = 0, np.zeros(64, dtype=np.int64)
    for at in range(0, max(len(words), 1), CHUNK_WORDS):
        part = words[at : at + CHUNK_WORDS + size - 1]
        if at and len(part) < size:
            break  # its shingles were all in the run before
        hashes = shingle_hashes(part, size, seed)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    bits = counts * 2 > total
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: id and ``fp`` (the fingerprint's 64 bits as a signed long). Null counts as empty: 0."""

    def make():
        def step(batch):
            fps = [fingerprint(v.as_py() or b"", size, seed) for v in batch.column(1)]
            return {id_col: batch.column(0), "fp": np.array(fps, dtype=np.uint64).astype(np.int64)}

        return step

    binary = docs.select(id_col, F.col(text_col).cast("binary").alias("_t"))
    return arrow_map(binary, make, f"{id_col} {dict(docs.dtypes)[id_col]}, fp long")


def _entries(bits: int) -> list[tuple[int, ...]]:
    """The positions of each list: one fewer than linked fingerprints share at least, so that the tally decides."""
    return list(combinations(range(BYTES), max(1, BYTES - bits - 1)))


def index_entries(fps: DataFrame, bits: int) -> DataFrame:
    """``entry`` (which positions), ``key`` (their bytes) and ``fp``: one row per combination of positional bytes."""
    made = []
    for number, places in enumerate(_entries(bits)):
        key = F.lit(0).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * (BYTES - 1 - p)).bitwiseAND(255))
        made.append(F.struct(F.lit(number).cast("short").alias("entry"), key.alias("key")))
    return fps.select(F.explode(F.array(*made)).alias("e"), "fp").select("e.entry", "e.key", "fp")


def linked_within(fps: np.ndarray, places: tuple[int, ...], bits: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links among distinct fingerprints that share the bytes at ``places``.

    Each pair's shared positional bytes are tallied; pairs that reach the minimum ``8 - bits``, and whose first
    shared bytes are those of this list, are verified. The rows of a block are compared with all, so memory is bounded.
    """
    n, least = len(fps), BYTES - bits
    parent = np.arange(n)
    cells = fps.astype(">u8").view(np.uint8).reshape(n, BYTES)
    out_a, out_b = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, n, rows):
        tally = np.zeros((min(rows, n - at), n), dtype=np.uint8)
        first = np.ones(tally.shape, dtype=bool)
        for p in range(BYTES):
            shared = cells[at : at + rows, p, None] == cells[None, :, p]
            tally += shared
            if p < places[-1] and p not in places:
                first &= ~shared
        i, j = np.nonzero((tally >= least) & first)
        i += at
        keep = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= bits)
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out_a.append(x)
                out_b.append(y)
    return fps[np.array(out_a, dtype=np.int64)], fps[np.array(out_b, dtype=np.int64)]


def _links_of_entries(entries: DataFrame, bits: int) -> DataFrame:
    """Links within entries of up to ``DENSE`` fingerprints; a denser entry gives its rows back with ``b`` null.

    Rows come sorted by entry; a task walks over the runs, so no group is built by Spark, and a dense
    entry is passed on as it streams by, never gathered.
    """
    combos = _entries(bits)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("entry", pa.int16()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, dense = None, [], False

        def passed_on(key, fps):
            n = len(fps)
            return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(n, pa.int64()), pa.array(np.full(n, key[0], np.int16)), pa.array(np.full(n, key[1]))], schema=schema)

        def close():
            fps = np.concatenate(held) if held else np.zeros(0, np.int64)
            if not dense and len(fps) > 1:
                a, b = linked_within(fps.view(np.uint64), combos[open_key[0]], bits)
                if len(a):
                    n = len(a)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int16()), pa.nulls(n, pa.int64())], schema=schema)

        for batch in batches:
            entry, key, fp = (batch.column(k).to_numpy() for k in range(3))
            if not len(fp):
                continue
            cut = np.flatnonzero((entry[1:] != entry[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cut))
            ends = np.concatenate((cut, [len(fp)]))
            many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp)))  # runs of one inside a batch have no pairs
            for k in many.tolist():
                s, e = starts[k], ends[k]
                this = (int(entry[s]), int(key[s]))
                if this != open_key:
                    yield from close()
                    open_key, held, dense = this, [], False
                held.append(fp[s:e])
                if not dense and sum(map(len, held)) > DENSE:
                    dense = True
                if dense:
                    yield passed_on(open_key, np.concatenate(held))
                    held = []
        if open_key is not None:
            yield from close()

    return entries.mapInArrow(run, "a long, b long, entry short, key long")


def _dense_links(rows: DataFrame, bits: int) -> DataFrame:
    """Links of dense entries, in proportion to their size and without comparing pairs.

    Two fingerprints differ in at most ``bits`` bits just if some word differs from one in at most
    ``ceil(bits / 2)`` bits and from the other in at most ``floor(bits / 2)``. Each fingerprint is
    dealt to all words that near it (in the free bytes of its entry), and each one at a word is linked
    to the least that comes within ``floor(bits / 2)`` of it, so that each link is within ``bits``.
    """
    combos = _entries(bits)
    near, far = bits // 2, bits - bits // 2

    def make():
        masks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def step(batch):
            entry, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words, whose, reach = [], [], []
            for e in np.unique(entry):
                if e not in masks:
                    free = [8 * (BYTES - 1 - p) + k for p in range(BYTES) if p not in combos[e] for k in range(8)]
                    made = [(sum(1 << x for x in c), n) for n in range(far + 1) for c in combinations(free, n)]
                    masks[e] = np.array([m for m, _ in made], dtype=np.uint64), np.array([n for _, n in made], dtype=np.int16)
                mask, flips = masks[e]
                own = fp[entry == e]
                words.append((own.view(np.uint64)[:, None] ^ mask[None, :]).ravel())
                whose.append(np.repeat(own, len(mask)))
                reach.append(np.tile(flips, len(own)))
            return {"word": np.concatenate(words).view(np.int64), "fp": np.concatenate(whose), "flips": np.concatenate(reach)}

        return step

    dealt = arrow_map(rows.select("entry", "fp").distinct().repartition("fp"), make, "word long, fp long, flips short")
    hubs = dealt.where(F.col("flips") <= near).groupBy("word").agg(F.min("fp").alias("hub"))
    return dealt.join(hubs.hint("merge"), "word").where(F.col("fp") != F.col("hub")).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``bits`` bits."""
    entries = index_entries(fps, bits).repartition("entry", "key").sortWithinPartitions("entry", "key", "fp")
    found = stored(_links_of_entries(entries, bits), "simhash-links")
    sparse = found.where(F.col("b").isNotNull()).select("a", "b")
    dense = found.where(F.col("b").isNull()).select("entry", F.col("a").alias("fp"))
    if dense.isEmpty():
        return sparse
    return sparse.unionAll(_dense_links(dense, bits))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42, bits: int = 4
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id reachable.

    Documents with equal fingerprints are linked, also those without words (fingerprint zero; null and
    empty texts too). Null ids keep their row and lend no component id. Other columns are ignored.
    """
    of_rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, size=size, seed=seed), "fingerprints")
    heads = of_rows.groupBy("fp").agg(F.min(id_col).alias("head"))
    parts = connected_components(near_links(heads.select("fp"), bits))
    classes = heads.join(parts.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "head", F.coalesce("component", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("head").alias("component_id"))
    named = stored(classes.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id"), "simhash-classes")
    return of_rows.join(named.hint("merge"), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
