"""Substring deduplication: passages that repeat, exactly or nearly, within and across documents.

1. A text is cut twice: into its lines, and, line ends ignored, into pieces whose ends are chosen by content (a word
   whose hash is the least for ``REACH`` words on both sides), so that a passage is cut alike wherever it stands.
2. Lines of ``least_words`` words and all pieces get MinHash bands over their word shingles. Eight bands of three rows
   find lines of similarity 0.8 with probability 0.997; pieces (about a dozen shingles) have three bands of two rows,
   0.953, and equal ones always collide.
3. In each collision the most central text is compared with the others; components are formed; where a collision still
   holds several components, its texts, or in large ones those that share one of their rarest shingles, are compared. So no colliding pair that is similar enough stays apart, and no group is paired with itself.
4. Candidates are verified by the exact Jaccard similarity of their shingle sets; connected components make the classes;
   all occurrences but the first of a class are removals.
5. Neighbouring units are joined into spans; spans of fewer than ``least_run`` words of pieces are no repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_map, arrow_schema, stored, texts_of
from siftlake.llm.components import connected_components
from siftlake.llm.decontaminate import FILTER_BITS, filter_of, places, sized_filter

#: A piece ends before a word whose hash is least among this many on both sides; the longest piece.
REACH, LONGEST = 8, 32
#: Bands and rows for lines (and whole texts), and for pieces.
LINE_BANDS, PIECE_BANDS = (8, 3), (3, 2)
#: Texts that a task remembers to have seen.
SEEN = 250_000
#: Texts of a block that are compared at once, and texts that pass by one block in one task.
QUERIES, PASSING = 512, 4096
#: Texts of a collision that are compared at once; in larger ones, texts with a rarest shingle in common that are paired.
SMALL, FEW = 64, 16
SLAB = 1_000_000
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, 64, dtype=np.uint64)
_MOST = np.uint64(np.iinfo(np.uint64).max)
_SPACES = np.zeros(0x3002, dtype=bool)
_SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[str], size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words (all words if fewer)."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - size + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + size])) for k in range(n)], dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


# ---- words, lines and pieces


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (code points) of each word of a text, and whether a line ends before it."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    space = np.ones(len(points) + 2, dtype=bool)
    space[1:-1] = _SPACES[np.minimum(points, 0x3001)]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    lines = np.cumsum(points == 10)
    before = lines[starts] if len(starts) else starts
    return starts, ends, np.concatenate(([True], before[1:] != before[:-1])) if len(starts) else np.zeros(0, dtype=bool)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text in lower case, computed over its code points, a slab of characters at a time."""
    out = []
    lowered = text.lower()
    at = 0
    while at < len(lowered):
        end = at + SLAB
        while end < len(lowered) and not lowered[end].isspace():
            end += 1
        slab = lowered[at:end]
        at = end
        starts, ends, _ = word_spans(slab)
        if not len(starts):
            continue
        points = np.frombuffer(slab.encode("utf-32-le"), dtype=np.uint32)
        sizes = ends - starts
        powers = np.cumprod(np.full(int(sizes.max()), 0xD6E8FEB86659FD93, dtype=np.uint64))
        place = np.arange(len(points)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(points)])))) if starts[0] == 0 else None
        if place is None:  # white space at the beginning counts with the first word
            place = np.arange(len(points)) - np.repeat(starts, np.diff(np.concatenate(([0], starts[1:], [len(points)]))))
        inside = (place >= 0) & ~_SPACES[np.minimum(points, 0x3001)]
        value = np.where(inside, (points.astype(np.uint64) + np.uint64(1)) * powers[np.clip(place, 0, len(powers) - 1)], np.uint64(0))
        out.append(mixed(np.add.reduceat(value, starts) + sizes.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words from each word on, as far as they go; the last ones are of no use."""
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(min(size, len(words))):
        out[: len(words) - k] = mixed(out[: len(words) - k] ^ words[k:])
    return out


def piece_starts(words: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """First words of the pieces: places chosen by content, and in long pieces every ``LONGEST`` words.

    ``fresh`` marks each text's first word; what is chosen in a text does not depend on its neighbours.
    """
    n = len(words)
    order = mixed(words)
    order = np.where(fresh, order, mixed(order ^ np.concatenate((words[:1], words[:-1]))))
    text = np.cumsum(fresh)
    chosen = np.ones(n, dtype=bool)
    for k in range(1, min(REACH, n - 1) + 1):
        apart = text[k:] != text[:-k]
        chosen[:-k] &= (order[:-k] <= order[k:]) | apart
        chosen[k:] &= (order[k:] < order[:-k]) | apart
    starts = np.flatnonzero(chosen | fresh)
    within = np.arange(n) - np.repeat(starts, np.diff(np.concatenate((starts, [n]))))
    return np.flatnonzero(within % LONGEST == 0)


def least_of(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, size: int, bands: tuple[int, int], alone: np.ndarray) -> np.ndarray:
    """Band keys (units x bands) of units of words, from the hashes of the runs at each word.

    A unit shorter than a run has one shingle, ``alone``. Hash functions are taken one at a time, so memory is a few
    times the words.
    """
    n, rows = bands
    last = np.repeat(starts + sizes - size, sizes)
    valid = np.arange(len(last)) <= last
    short = sizes < size
    keys = np.zeros((len(starts), n), dtype=np.uint64)
    for band in range(n):
        key = np.full(len(starts), band * 64 + rows, dtype=np.uint64)
        for row in range(rows):
            j = band * rows + row
            values = hashes * _A[j] + _B[j]
            values ^= values >> np.uint64(31)
            least = np.minimum.reduceat(np.where(valid, values, _MOST), starts)
            own = alone * _A[j] + _B[j]
            key = mixed(key + np.where(short, own ^ (own >> np.uint64(31)), least))
        keys[:, band] = key
    return keys


def unit_hashes(words: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit hashes (n x 2) of units from their words and the words' places in them."""
    return np.stack([np.add.reduceat(mixed(words ^ mixed(place + np.uint64(seed))), first) for seed in (11, 1 << 40)], axis=1)


class Seen:
    """What a task has met so far, so that it says of each text and band key only what is news.

    A text's band keys count at its first occurrence; its second one shows that it repeats. Of each key the first two texts
    are to be checked against other tasks; the others collide for certain. So a text or key that very many rows
    share costs a task two rows of the shuffle at most. Beyond ``SEEN`` texts it begins anew, which costs rows, not results.
    """

    def __init__(self) -> None:
        self.texts: dict[tuple[int, int], int] = {}
        self.keys: dict[int, int] = {}

    def news(self, hashes: np.ndarray, keys: np.ndarray) -> dict[str, pa.Array]:
        """Columns ``bands`` (keys to be checked), ``sure`` (keys that collide) and ``again`` (the text's second occurrence)."""
        if len(self.texts) > SEEN:
            self.texts.clear()
            self.keys.clear()
        texts, known = self.texts, self.keys
        again, bands, sure, n_bands, n_sure = np.zeros(len(hashes), dtype=bool), [], [], [0], [0]
        for j, (h, own) in enumerate(zip(map(tuple, hashes.tolist()), keys.view(np.int64).tolist(), strict=True)):
            times = texts.get(h, 0)
            if times == 0:
                for key in own:
                    count = known.get(key, 0)
                    if count < 2:
                        known[key] = count + 1
                        bands.append(key)
                    else:
                        sure.append(key)
            if times < 2:
                texts[h] = times + 1
                again[j] = times == 1
            n_bands.append(len(bands))
            n_sure.append(len(sure))
        lists = lambda n, flat: pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(flat, pa.int64()))
        return {"bands": lists(n_bands, bands), "sure": lists(n_sure, sure), "again": pa.array(again)}


def hash_columns(hashes: np.ndarray) -> dict[str, pa.Array]:
    """Columns ``h`` and ``k``."""
    h = pa.Array.from_buffers(pa.binary(16), len(hashes), [None, pa.py_buffer(np.ascontiguousarray(hashes))]).cast(pa.binary())
    return {"h": h, "k": pa.array(hashes[:, 0].copy().view(np.int64))}


def whole_texts(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and band keys of whole texts; zeros for those without words."""
    joined = "\n".join(texts)
    starts, _, _ = word_spans(joined)
    hashes, keys = np.zeros((len(texts), 2), dtype=np.uint64), np.zeros((len(texts), LINE_BANDS[0]), dtype=np.uint64)
    if len(starts):
        words = word_hashes(joined)
        of = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), starts, side="right") - 1
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        sizes = np.diff(np.concatenate((first, [len(words)])))
        hashes[of[first]] = unit_hashes(words, (np.arange(len(words)) - np.repeat(first, sizes)).astype(np.uint64), first)
        keys[of[first]] = least_of(runs(words, size), first, sizes, size, LINE_BANDS, hashes[of[first], 0])
    return hashes, keys


class Cutter:
    """Cuts texts into lines of enough words (kind 0) and pieces (kind 1); many texts at once, as arrays."""

    def __init__(self, least_words: int, size: int) -> None:
        self.least_words, self.size = least_words, size

    def __call__(self, texts: list[str], with_bands: bool = True) -> list[tuple[np.ndarray, ...]]:
        """For each kind: texts' numbers, starts and ends (code points), numbers of words, hashes (n x 2), band keys or None,
        and the first word's number among the words of all texts."""
        joined = "\n".join(texts)
        starts, ends, lines = word_spans(joined)
        if not len(starts):
            return []
        words = word_hashes(joined)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        text = np.searchsorted(begins, starts, side="right") - 1
        fresh = np.concatenate(([True], text[1:] != text[:-1]))
        grams = runs(words, self.size) if with_bands else None
        n, out = len(words), []
        for kind in (0, 1):
            first = np.flatnonzero(lines) if kind == 0 else piece_starts(words, fresh)
            sizes = np.diff(np.concatenate((first, [n])))
            place = (np.arange(n) - np.repeat(first, sizes)).astype(np.uint64)
            both = unit_hashes(words, place, first)
            keep = sizes >= self.least_words if kind == 0 else np.ones(len(first), dtype=bool)
            keys = least_of(grams, first, sizes, self.size, (LINE_BANDS, PIECE_BANDS)[kind], both[:, 0])[keep] if with_bands else None
            until = ends[first + sizes - 1]
            if kind:  # a piece reaches to the beginning of the next one of its text
                until[:-1] = np.where(fresh[first[1:]], until[:-1], starts[first[1:]])
            of = text[first]
            out.append((of[keep], (starts[first] - begins[of])[keep], (until - begins[of])[keep], sizes[keep], both[keep], keys, first[keep]))
        return out


def units(docs: DataFrame, *, id_col: str, text_col: str, least_words: int, size: int) -> DataFrame:
    """One row per unit: ``row`` (a number of the document's row), ``id``, ``start``, ``end``, ``words`` (their number),
    ``kind``, ``h`` (128-bit hash of the words), ``k`` (its first half), and ``bands``, ``sure`` and ``again`` (see ``Seen``).
    """
    schema = f"row long, id {dict(docs.dtypes)[id_col]}, start long, end long, words int, kind byte, h binary, k long, bands array<long>, sure array<long>, again boolean"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Cutter(least_words, size), Seen()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for kind, (of, starts, ends, sizes, both, keys, _) in enumerate(cut(list(texts_of(batch.column(1))))):
                made = {"row": row + of, "id": batch.column(0).take(pa.array(of)), "start": starts, "end": ends, "words": sizes, "kind": np.full(len(of), kind)}
                made |= hash_columns(both) | seen.news(both, keys)
                columns = (made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name]) for f in arrow)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            row += batch.num_rows

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def words_of(docs: DataFrame, wanted: DataFrame, *, text_col: str, least_words: int, size: int) -> DataFrame:
    """``h`` and ``words`` (in lower case, space-joined) of the units whose ``k`` is in ``wanted``, from a second reading of
    the texts: storing all words would cost several times the input. A bitmap, sized by their number up to 32 MB, passes over most others."""
    shared = docs.sparkSession.sparkContext.broadcast(sized_filter(wanted.select(F.col("k").alias("g"))))

    def make():
        bits, cut, seen = shared.value, Cutter(least_words, size), set()

        def step(batch):
            hashes, found, words = [], [], None
            texts = list(texts_of(batch.column(0)))
            for _, _, _, sizes, both, _, first in cut(texts, with_bands=False):
                for j in places(both[:, 0], bits).tolist():
                    h = both[j].tobytes()
                    if h not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(h)
                        words = words or "\n".join(texts).lower().split()
                        hashes.append(h)
                        found.append(" ".join(words[first[j] : first[j] + sizes[j]]))
            return {"h": hashes, "words": found}

        return step

    found = arrow_map(docs.select(text_col), make, "h binary, words string")
    return found.dropDuplicates(["h"])


# ---- collisions and links


def colliding(keyed: DataFrame) -> DataFrame:
    """``key``, ``k`` and ``repeats`` of the rows (``key``, ``k``) that are not alone: with another ``k`` at their key
    (``repeats`` false), or there more than once (true). One row for each key and ``k`` and case.

    One shuffle and a sort; a task looks at neighbouring rows as they stream by and holds a single one,
    so a key that very many rows share needs no memory.
    """
    schema = "key long, k long, repeats boolean"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, k = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the rows of the last key and k so far: one or two
        other = False  # whether the last key had another k before

        def told(key, k, twice, met):
            n, m = np.flatnonzero(met), np.flatnonzero(twice)
            both = np.concatenate((n, m))
            return pa.RecordBatch.from_arrays([pa.array(key[both]), pa.array(k[both]), pa.array(np.arange(len(both)) >= len(n))], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, k = np.concatenate((key, batch.column(0).to_numpy())), np.concatenate((k, batch.column(1).to_numpy()))
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (k[1:] != k[:-1])))
            heads = np.flatnonzero(first)
            counts = np.diff(np.concatenate((heads, [len(key)])))
            a, b = key[heads], k[heads]
            met = np.zeros(len(a), dtype=bool)
            same = a[1:] == a[:-1]
            met[1:] |= same
            met[:-1] |= same
            met[0] |= other
            if len(a) > 1:
                yield told(a[:-1], b[:-1], counts[:-1] > 1, met[:-1])
                other = bool(same[-1])
            keep = min(int(counts[-1]), 2)
            key, k = np.repeat(a[-1:], keep), np.repeat(b[-1:], keep)
        if len(key):
            yield told(key[:1], k[:1], np.array([len(key) > 1]), np.array([other]))

    return keyed.select("key", "k").repartition("key").sortWithinPartitions("key", "k").mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose words have shingle sets that are similar enough."""
    first = pairs.join(sets.select(F.col("h").alias("a"), F.col("words").alias("wa")).hint("merge"), "a")
    both = first.join(sets.select(F.col("h").alias("b"), F.col("words").alias("wb")).hint("merge"), "b")

    def make():
        def step(batch):
            good = [
                jaccard(shingles(x.as_py().split(), size), shingles(y.as_py().split(), size)) >= similarity
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            kept = batch.filter(pa.array(good, pa.bool_()))
            return {"a": kept.column(0), "b": kept.column(1)}

        return step

    return arrow_map(both.select("a", "b", "wa", "wb"), make, "a binary, b binary")


def _compare(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links between the queries of a group (``key``, ``block``, ``salt``) and the other rows of the group, by exact Jaccard.

    Rows come sorted, a group's queries first: they are held, at most about ``QUERIES``, with an index of their shingles;
    the others pass by one at a time. One link for two components is enough.
    """
    schema = "a binary, b binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, sets, index, linked = None, [], [], None, set()
        for batch in batches:
            out = []
            for key, block, salt, role, h, c, words in zip(*(batch.column(n).to_pylist() for n in range(7)), strict=True):
                if (key, block, salt) != group:
                    group, held, sets, index, linked = (key, block, salt), [], [], None, set()
                found = shingles(words.split(), size)
                if role == 0:
                    held.append((h, c))
                    sets.append(found)
                    continue
                if index is None:  # all queries of the group are there: their shingles in order, with whose they are
                    sizes = np.array([len(x) for x in sets])
                    all_ = np.concatenate(sets)
                    order = np.argsort(all_, kind="stable")
                    index = all_[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
                ordered, owners, sizes = index
                low, high = np.searchsorted(ordered, found, "left"), np.searchsorted(ordered, found, "right")
                n = high - low
                total = int(n.sum())
                if not total:
                    continue
                both = np.bincount(owners[np.arange(total) + np.repeat(low - np.cumsum(n) + n, n)], minlength=len(sets))
                for j in np.flatnonzero(both >= similarity * (sizes + len(found) - both)).tolist():
                    g, d = held[j]
                    if d != c and (c, d) not in linked:
                        linked |= {(c, d), (d, c)}
                        out.append((g, h))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.binary()) for n in (0, 1)], schema=arrow)

    return rows.mapInArrow(run, schema)


def rarest(texts: DataFrame, *, size: int, similarity: float) -> DataFrame:
    """``h``, ``n`` (the number of its shingles), and of the rarest of them, in order, those that another text may hold: ``rare``,
    and ``left``, how many of the text's shingles come from it on.

    Of two sets with at least that Jaccard similarity, each holds at least that part of the other in common with it. So of n
    shingles in an order that all texts agree on, the first n - ceil(similarity * n) + 1 cannot all be missing in the other
    set. Which order is free; shingles come first that few texts hold. How many is told in four levels by three bitmaps
    of 2 MB over the shingles' lowest bits: a wrong level costs rows, not results.
    """

    def counted():
        def step(batch):
            held = [shingles(w.split(), size) for w in texts_of(batch.column(0))]
            if held:  # summed in the batch: texts over one form have most shingles in common
                g, n = np.unique(np.concatenate(held) & np.uint64(FILTER_BITS - 1), return_counts=True)
                return {"g": g.view(np.int64), "n": n}

        return step

    held = arrow_map(texts.select("words"), counted, "g long, n long")
    counts = stored(held.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1"), "shingle-counts")
    levels = texts.sparkSession.sparkContext.broadcast([filter_of(counts.where(F.col("n") > least).select("g")) for least in (1, 16, 256)])

    def first():
        def step(batch):
            sizes, rare, left = [], [], []
            for words in texts_of(batch.column(1)):
                found = shingles(words.split(), size)
                low = found & np.uint64(FILTER_BITS - 1)
                level = sum((bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 for bits in levels.value)
                order = np.lexsort((found, level))[: len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1]
                at = np.flatnonzero(level[order])  # a shingle of the lowest level is in this text alone
                sizes.append(len(found))
                rare.append(found[order[at]].view(np.int64))
                left.append(len(found) - at)
            return {"h": batch.column(0), "n": sizes, "rare": rare, "left": left}

        return step

    return arrow_map(texts.select("h", "words"), first, "h binary, n int, rare array<long>, left array<int>")


def _shared_keys(keys: np.ndarray, rare: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of collision and shingle for each rare shingle of each row, and the rows' numbers."""
    sizes = rare.value_lengths().to_numpy()
    of = np.repeat(np.arange(len(sizes)), sizes)
    return mixed(keys.view(np.uint64)[of] ^ mixed(rare.flatten().to_numpy().view(np.uint64))), of


def shared_shingles(rows: DataFrame) -> DataFrame:
    """The rows (``key``, ``h``, ``c``, ``outside``, ``n``, ``rare``, ``left``) with a rare shingle that another row of their collision has: ``dense`` if more than
    ``FEW`` rows there share one; ``g`` and ``left`` of those that fewer share.

    Rows are never joined by shingle: texts with collision and shingle are counted, summed in the task first, and two bitmaps over the counts, sized
    by their number up to 32 MB, tell which are shared and by how many. A bit that is set by chance makes a row dense or keeps a lone shingle.
    """
    arrow = arrow_schema("g long, n long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def told():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], schema=arrow)

        for batch in batches:
            if total > SLAB:
                yield told()
                held, total = [], 0
            held.append(_shared_keys(batch.column(0).to_numpy(), batch.column(1))[0])
            total += len(held[-1])
        if held:
            yield told()

    sums = rows.select("key", "rare").mapInArrow(counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(sums, "shared-counts")
    shared = rows.sparkSession.sparkContext.broadcast([sized_filter(counts.where(F.col("n") > least).select("g")) for least in (1, FEW)])

    def make():
        def step(batch):
            keys, of = _shared_keys(batch.column(0).to_numpy(), batch.column(5))
            left = batch.column(6).flatten().to_numpy()
            any_, many = (np.zeros(len(keys), dtype=bool) for _ in range(2))
            for hit, bits in zip((any_, many), shared.value, strict=True):
                hit[places(keys, bits)] = True
            dense = np.bincount(of[many], minlength=batch.num_rows) > 0
            few = np.flatnonzero(any_ & ~many)
            sizes = np.bincount(of[few], minlength=batch.num_rows)
            keep = np.flatnonzero(dense | (sizes > 0))  # rows come in order, so the lists of those kept are whole
            ends = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (keys[few].view(np.int64), left[few]))
            columns = [batch.column(k).take(pa.array(keep)) for k in range(5)]
            return dict(zip(("key", "h", "c", "outside", "n", "dense", "g", "left"), [*columns, pa.array(dense[keep]), *lists], strict=True))

        return step

    columns = rows.select("key", "h", "c", "outside", "n", "rare", "left")
    return arrow_map(columns, make, "key long, h binary, c binary, outside boolean, n int, dense boolean, g array<long>, left array<int>")


def links_of(met: DataFrame, sets: DataFrame, *, size: int, similarity: float) -> DataFrame:
    """Links (a, b) that join just the texts which a chain of similar, colliding texts joins.

    ``met`` has the collisions (``key``, ``h``), each with several texts, and ``sets`` the ``words`` of these. The text of a
    collision that has most company over all its collisions is its centre: for the copies of one text that is the
    same text in all bands, so that each copy is verified once. What is not joined to the centre of a collision by
    then is looked for among the texts of other components there; where there are but two texts, that is done.
    """
    met = stored(met.distinct(), "met")
    company = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = met.join(company.hint("merge"), "key").groupBy("h").agg(F.sum("n").alias("w"))
    weighed = stored(met.join(weight.hint("merge"), "h"), "weighed")
    centres = stored(weighed.groupBy("key").agg(F.max_by("h", F.struct("w", "h")).alias("centre")), "centres")
    pairs = weighed.join(centres.hint("merge"), "key").where(F.col("h") != F.col("centre")).select(F.col("h").alias("a"), F.col("centre").alias("b")).distinct()
    links = stored(verified(pairs, sets, size, similarity), "links")
    parts = stored(connected_components(links), "components")
    own = F.coalesce("component", "h").alias("c")
    named = stored(met.join(parts.hint("merge"), F.col("h") == F.col("node"), "left").select("key", "h", own), "named")
    central = centres.join(parts.hint("merge"), F.col("centre") == F.col("node"), "left").select("key", F.coalesce("component", "centre").alias("main"))
    sides = named.join(central.hint("merge"), "key").withColumn("outside", F.col("c") != F.col("main"))
    count = sides.groupBy("key").agg(F.count_if("outside").alias("o"), F.count(F.lit(1)).alias("n")).where("o > 0 and n > 2").select("key", F.col("n").alias("company"))
    sides = stored(sides.join(stored(count, "open-collisions").hint("merge"), "key").select("key", "company", "h", "c", "outside"), "open-sides")
    return links.unionAll(links_outside(sides, sets, size=size, similarity=similarity))


def links_outside(sides: DataFrame, sets: DataFrame, *, size: int, similarity: float) -> DataFrame:
    """Links between texts of different components in the open collisions ``sides`` (``key``, its number of texts ``company``, ``h``, ``c``, ``outside``).

    Collisions of at most ``SMALL`` texts are compared as they are. In larger ones, similar texts share one of their rarest
    shingles (see ``rarest``). Where at most ``FEW`` texts of a collision share one, pairs of like size are verified, so a text
    meets a bounded number of others for each. The texts with a rarest shingle that more of them share are compared in
    blocks, the outside ones with all such texts of the collision. All ways are exact.
    """
    large = sides.where(F.col("company") > SMALL)
    texts = stored(sets.join(large.select("h").distinct().hint("merge"), "h", "left_semi").select("h", "words"), "open-texts")
    rare = stored(rarest(texts, size=size, similarity=similarity), "rarest")
    told = stored(large.join(rare.hint("merge"), "h").select("key", "h", "c", "outside", "n", "rare", "left"), "rare-shingles")
    shared = stored(shared_shingles(told), "shared-shingles")

    few = shared.select("h", "c", "n", F.inline(F.arrays_zip("g", "left"))).select("g", "h", "c", "n", "left")
    other = few.toDF("g", "h2", "c2", "n2", "left2")
    common = F.least("left", "left2")  # of the first shingle in order that both have on, so many at most are in both
    alike = (F.col("h") < F.col("h2")) & (F.col("c") != F.col("c2")) & (common >= F.lit(similarity - 1e-9) * (F.col("n") + F.col("n2") - common))
    pairs = few.join(other.hint("merge"), "g").where(alike).select(F.col("h").alias("a"), F.col("h2").alias("b")).distinct()
    links = stored(verified(pairs, texts, size, similarity), "links-few")

    small = sides.where(F.col("company") <= SMALL).select("key", "h", "c", "outside")
    dense = stored(shared.where("dense").select("key", "h", "c", "outside").unionAll(small), "dense-sides")
    count = dense.groupBy("key").agg(F.count_if("outside").alias("o"), F.count(F.lit(1)).alias("n")).where("o > 0")
    blocks, salts = F.ceil(F.col("o") / QUERIES).cast("int").alias("blocks"), F.ceil(F.col("n") / PASSING).cast("int").alias("salts")
    split = dense.join(stored(count.select("key", blocks, salts), "dense-collisions").hint("merge"), "key")
    open_rows = stored(split.join(sets.hint("merge"), "h").select("key", "blocks", "salts", "outside", "h", "c", "words"), "open-rows")
    at = F.xxhash64("h")
    asking = open_rows.where("outside").select("key", F.pmod(at, F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "h", "c", "words")
    passing = open_rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(at, F.col("salts")).alias("salt"), F.lit(1).alias("role"), "h", "c", "words")
    dealt = asking.unionByName(passing).repartition("key", "block", "salt").sortWithinPartitions("key", "block", "salt", "role")
    return links.unionAll(stored(_compare(dealt, size, similarity), "links-outside"))


# ---- the operator


def text_classes(table: DataFrame, words_for: Callable[[DataFrame], DataFrame], *, order: list[str], size: int, similarity: float, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` (with ``h``, ``k``, ``bands``, ``sure`` and ``again``) whose texts repeat or collide, and ``h``, ``class_size`` and
    ``least`` (the struct ``order`` of the class's first occurrence) of the texts that have a class of several occurrences.

    ``words_for`` gives ``h`` and ``words`` of the texts of a table with ``k``; ``more`` has collisions found elsewhere, as of ``colliding``.
    """
    checked = colliding(table.select(F.explode("bands").alias("key"), "k"))
    sure = table.select(F.explode("sure").alias("key"), "k", F.lit(False).alias("repeats"))
    twice = table.where("again").select(F.lit(0).cast("long").alias("key"), "k", F.lit(True).alias("repeats"))
    found = checked.unionAll(sure).unionAll(twice)
    hits = stored(found if more is None else found.unionAll(more), "collisions")
    again = stored(table.drop("bands", "sure", "again").join(hits.select("k").distinct().hint("merge"), "k", "left_semi"), "again")
    texts = stored(again.groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")), "texts")
    near = hits.where(~F.col("repeats")).select("key", "k")
    met = near.join(texts.select("k", "h").hint("merge"), "k").select("key", "h")
    sets = stored(words_for(near), "words")
    parts = stored(connected_components(links_of(met, sets, size=size, similarity=similarity)), "classes")
    named = texts.join(parts.hint("merge"), F.col("h") == F.col("node"), "left").select("h", "n", "first", F.coalesce("component", "h").alias("class"))
    classes = named.groupBy("class").agg(F.sum("n").alias("class_size"), F.min("first").alias("least")).where("class_size > 1")
    return again, stored(named.select("h", "class").join(classes.hint("merge"), "class").select("h", "class_size", "least"), "text-classes")


def _occurrences(docs: DataFrame, *, id_col: str, text_col: str, least_words: int, size: int, similarity: float) -> DataFrame:
    """The units that repeat: ``row``, ``id``, ``start``, ``end``, ``words``, ``kind``, ``class_id``, ``class_size`` and ``removed``."""
    named = docs.where(F.col(id_col).isNotNull())
    table = stored(units(named, id_col=id_col, text_col=text_col, least_words=least_words, size=size), "units")
    order = ["id", "row", "start"]
    again, of_text = text_classes(
        table, lambda near: words_of(named, near, text_col=text_col, least_words=least_words, size=size), order=order, size=size, similarity=similarity
    )
    return again.join(of_text.hint("merge"), "h").select(
        "row", "id", "start", "end", "words", "kind", F.col("least.id").alias("class_id"), "class_size", (F.struct(*order) != F.col("least")).alias("removed")
    )


def _islands(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Numbers the runs of touching or overlapping spans among the rows of equal keys."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))).withColumn(name, F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _spans(docs: DataFrame, *, id_col: str, text_col: str, least_words: int, least_run: int, size: int, similarity: float) -> DataFrame:
    """``row``, ``id``, ``start``, ``end``, ``class_id``, ``class_size`` and ``removed`` of the spans that ``repeated`` returns."""
    found = _occurrences(docs, id_col=id_col, text_col=text_col, least_words=least_words, size=size, similarity=similarity)
    whole = _islands(stored(found, "occurrences"), ["row"], "island")
    total = F.sum(F.when(F.col("kind") == 1, F.col("words")).otherwise(0)).over(Window.partitionBy("row", "island"))
    lines = F.min("kind").over(Window.partitionBy("row", "island"))
    long_enough = whole.withColumn("total", total).withColumn("lines", lines).where((F.col("total") >= least_run) | (F.col("lines") == 0))
    alike = _islands(long_enough, ["row", "island", "class_id", "removed"], "part")
    return alike.groupBy("row", "id", "island", "class_id", "removed", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("class_size").alias("class_size"))


def repeated(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 40,
    least_run: int = 20,
    size: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """One row per span of repeated text: id, ``start``, ``end`` (code points), ``class_id``, ``class_size`` and ``removed``.

    A class holds the occurrences of similar lines, or of similar pieces (words in lower case, any white space); its
    ``class_id`` is the least id among them. The first occurrence (by id, then row, then place) stays, the others
    are ``removed``. Touching or overlapping occurrences of one ``class_id`` and decision are one span, whose
    ``class_size`` is its most frequent part's. Pieces count where neighbouring repeated ones have ``least_run`` words
    together, lines from ``least_words`` words on. A passage of over 50 words that repeats holds 20 words in
    whole pieces nearly always (tested); shorter ones may be found. Occurrences may be in one document.
    Null and empty texts and rows with a null id give no row; a repeated row repeats all its text and is removed
    like any later occurrence. Other columns are ignored.
    """
    spans = _spans(docs, id_col=id_col, text_col=text_col, least_words=least_words, least_run=least_run, size=size, similarity=similarity)
    return spans.select(F.col("id").alias(id_col), "start", "end", "class_id", "class_size", "removed")


def without_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 40,
    least_run: int = 20,
    size: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """``docs`` with removed spans cut out of their texts; all rows stay, an emptied text is empty.

    Of repeated rows the first keeps its text: occurrences are told apart by what ``repeated`` finds in each row. The
    columns stay as they are, whatever their names.
    """
    names = [f"c{n}" for n in range(len(docs.columns))]  # whatever the columns are called
    place = docs.columns.index(text_col)
    key, text = F.col(names[docs.columns.index(id_col)]), names[place]
    numbered = stored(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select(F.when(key.isNotNull(), F.struct(key.alias("id"), "row")).alias("id"), text)
    found = repeated(keyed, id_col="id", text_col=text, least_words=least_words, least_run=least_run, size=size, similarity=similarity).where("removed")
    spans = found.groupBy("id.row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone"))
    joined = numbered.join(spans.hint("merge"), "row", "left").select(*names, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, cuts in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                text, kept, at = value.as_py(), [], 0
                if text is not None and cuts.as_py():
                    for span in cuts.as_py():
                        kept.append(text[at : max(at, span["start"])])
                        at = max(at, span["end"])
                    text = "".join([*kept, text[at:]])
                out.append(text)
            field = batch.schema.field(place)
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(out, field.type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return joined.mapInArrow(run, docs.toDF(*names).schema).toDF(*docs.columns)
