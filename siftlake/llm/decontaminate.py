"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Rare word n-grams of a test item, those of at most ``RARE`` items, are its seeds. A more common n-gram is a seed only together with one of
   the item's rarest words: an alignment of the least score holds ceil(least_score * L) of an item's L words, so it holds one
   of any L - ceil(least_score * L) + 1 of them. Which words and n-grams count as rare changes the work but no result.
2. Seeds are joined to the documents that hold them; the words around them travel along, as many on each side as an
   alignment of the least score may reach: inserted words and all, an item of L words spans L + 2L(1 - least_score).
   Items are put into classes by length, so that a very long item widens the surroundings of its own seeds only.
3. A passage that holds too few of the item's words to reach the least score is passed over: no alignment
   matches a word that the passage has not.
4. Each other passage is aligned with the item; copies with edits keep a high score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_map, arrow_schema, stored

#: Bits of the filter that spares documents' other n-grams the join; its size is fixed (2 MB).
FILTER_BITS = 1 << 24
MOST_BITS, BITMAP = 1 << 28, 1 << 15
CHUNK = 50_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of an n-gram up to which it names them by itself.
RARE = 8


class Words(dict):
    """Words of a text as 64-bit hashes: lower case, split at white space, signs at a word's ends dropped. Keeps what it has hashed."""

    SIGNS = ".,;:!?\"'()[]{}|*#$%&<>-_"
    MOST = 500_000

    def __missing__(self, word: str) -> int:
        bare = word.strip(self.SIGNS)
        got = self[word] = xxhash.xxh64_intdigest(bare) if bare else 0
        return got

    def __call__(self, text: str) -> np.ndarray:
        if len(self) > self.MOST:
            self.clear()
        words = text.lower().split()
        got = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        return got[got != 0]  # a word of signs only is none


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; of all words if they are fewer."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def items_of(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """``item``, its ``words``, and its n-grams ``g`` (longs)."""

    def make():
        words_of = Words()

        def step(batch):
            words = [words_of(v.as_py() or "") for v in batch.column(1)]
            return {
                "item": batch.column(0),
                "words": [w.view(np.int64) for w in words],
                "g": [np.unique(grams(w, n)).view(np.int64) for w in words],
            }

        return step

    kind = dict(benchmark.dtypes)[item_col]
    return arrow_map(benchmark.select(item_col, text_col), make, f"item {kind}, words array<long>, g array<long>")


def joint(g: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A key for an n-gram together with a word, elementwise."""
    out = (g ^ (words * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def rare_words(items: DataFrame, least_score: float) -> DataFrame:
    """``item`` and ``w``: the words at an item's rarest places, as many as an alignment of the least score cannot all miss."""
    places = items.select("item", F.size("words").alias("size"), F.explode("words").alias("w"))
    held = places.select("item", "w").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("in_items"))
    order = Window.partitionBy("item").orderBy("in_items", "w")  # the places of one item
    ranked = places.join(held.hint("merge"), "w").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least_score) + 1).select("item", "w").distinct()


def seeds_of(items: DataFrame, least_score: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``key`` and ``item`` of all seeds; the common n-grams ``g``; the words ``g`` that go with them."""
    grams_ = items.where(F.size("words") > 0).select(F.explode("g").alias("g"), "item").distinct()
    common = stored(grams_.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RARE).select("g"), "common")
    alone = grams_.join(common.hint("merge"), "g", "left_anti").select(F.col("g").alias("key"), "item")
    pairs = grams_.join(common.hint("merge"), "g", "left_semi")
    words = stored(rare_words(items.join(pairs.select("item").distinct().hint("merge"), "item", "left_semi"), least_score), "rare-words")

    def make():
        return lambda batch: {"item": batch.column(0), "key": joint(*(np.asarray(batch.column(k)).view(np.uint64) for k in (1, 2))).view(np.int64)}

    both = arrow_map(pairs.join(words.hint("merge"), "item").select("item", "g", "w"), make, f"item {dict(items.dtypes)['item']}, key long")
    return alone.unionByName(both.distinct()), common, words.select(F.col("w").alias("g")).distinct()


def filter_of(keys: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of the lowest bits of the longs in column ``g`` (``size`` values), built by a bitmap aggregate."""
    low = F.col("g").bitwiseAND(size - 1)
    rows = keys.select(F.floor(low / BITMAP).alias("k"), (low % BITMAP).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("m"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.collect():  # at most size / BITMAP bitmaps of 4 KB
        bits[r["k"] * BITMAP // 8 : (r["k"] + 1) * BITMAP // 8] = np.frombuffer(r["m"], dtype=np.uint8)
    return bits


def sized_filter(keys: DataFrame) -> np.ndarray:
    """``filter_of`` of a stored table, sized by its rows: 16 bits each, 2 MB at least and 32 MB at most."""
    return filter_of(keys, min(MOST_BITS, max(FILTER_BITS, 1 << (16 * keys.count() - 1).bit_length())))


def places(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places in ``keys`` whose bit is set."""
    low = keys & np.uint64(8 * len(bits) - 1)
    return np.flatnonzero((bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: best local score and the aligned span of the passage.

    A row of the table is one vector operation; gaps within the row are closed by a running maximum.
    """
    m = len(passage)
    if not m or not len(item):
        return 0, 0, 0
    steps = -GAP * np.arange(m + 1)
    above = np.zeros(m + 1, dtype=np.int64)
    begin_above = np.arange(m + 1)
    best, span = 0, (0, 0)
    for word in item:
        hit = np.where(passage == word, MATCH, MISMATCH)
        diagonal, down = above[:-1] + hit, above[1:] + GAP
        row = np.zeros(m + 1, dtype=np.int64)
        row[1:] = np.maximum(np.maximum(diagonal, down), 0)
        begin = np.arange(m + 1)
        begin[1:] = np.where(row[1:] == 0, begin[1:], np.where(row[1:] == diagonal, begin_above[:-1], begin_above[1:]))
        reach = row + steps  # a gap along the row: row[j] = max over i <= j of row[i] - (j - i)
        from_ = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == from_, np.arange(m + 1), 0))
        closed = from_ - steps
        begin = np.where(closed > row, begin[source], begin)
        row = np.maximum(closed, row)
        top = int(row.argmax())
        if row[top] > best:
            best, span = int(row[top]), (int(begin[top]), top)
        above, begin_above = row, begin
    return best, *span


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 3,
    least_score: float = 0.5,
) -> DataFrame:
    """Aligned pairs: id, ``item_id``, ``score`` (best local score over that of a full match, 0 to 1), ``start`` and ``end``.

    A pair is returned just if within the reach of an n-gram that both hold there is an alignment of at least
    ``least_score``; the best one of a pair counts. ``start`` and ``end`` are places of words (signs dropped). Items
    without words, documents without words and null texts match nothing; an item of fewer than ``n`` words
    is one seed as a whole. Rows with a null id take no part; a repeated row gives its pairs once.
    """
    items = stored(items_of(benchmark.where(F.col(item_col).isNotNull()), n, item_col, item_text_col), "items")
    length_class = F.ceil(F.log2(F.size("words"))).cast("int")  # up to two to this power words
    classed = stored(items.where(F.size("words") > 0).select(F.explode("g").alias("g"), length_class.alias("length_class")).distinct(), "seeds")
    seeds, common, rare = seeds_of(items, least_score)
    seeds = stored(seeds, "keys")
    sizes = sorted({r[0] for r in items.select(F.least(F.size("words"), F.lit(n)).alias("m")).distinct().collect() if r[0] > 0})
    classes = sorted(r[0] for r in classed.select("length_class").distinct().collect())  # about thirty at most
    reaches = np.zeros(FILTER_BITS, dtype=np.uint8)  # for a key, one more than the class of the longest item that may have it
    for c in classes:
        reaches[np.unpackbits(filter_of(classed.where(F.col("length_class") == c)), bitorder="little").astype(bool)] = c + 1
    # 20 MB, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast((reaches, filter_of(common), filter_of(rare)))
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, start long, keys array<long>, words array<long>"
    arrow = arrow_schema(schema)

    def reach(words: np.ndarray | int) -> np.ndarray | int:
        return words + np.floor(2 * words * (1 - least_score)).astype(np.int64) if isinstance(words, np.ndarray) else words + int(2 * words * (1 - least_score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (reaches, often, seldom), words_of = shared.value, Words()

        def keys_of(g: np.ndarray, words: np.ndarray) -> np.ndarray:
            """A passage's n-grams, and the common ones with each word that may go with them."""
            g = np.unique(g)
            many = g[places(g, often)]
            if not len(many):
                return g
            words = np.unique(words[places(words, seldom)])
            return np.concatenate([g, joint(many[:, None], words[None, :]).ravel()])

        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(value.as_py() or "")
                hits, keys = [], []
                for size in sizes:
                    if len(words) >= size:
                        g = grams(words, size)
                        at = np.flatnonzero(reaches[g & np.uint64(FILTER_BITS - 1)])
                        if len(at):
                            hits.append(at)
                            keys.append(g[at])
                if not hits:
                    continue
                at, g = np.concatenate(hits), np.concatenate(keys)
                order = np.argsort(at, kind="stable")
                at, g = at[order], g[order]
                far = reach(np.left_shift(1, reaches[g & np.uint64(FILTER_BITS - 1)].astype(np.int64) - 1))
                low, high = np.maximum(at - far, 0), at + n + far
                # Seeds whose surroundings overlap share a passage; a passage spans at most CHUNK words and some.
                cut = np.flatnonzero((low[1:] > np.maximum.accumulate(high)[:-1]) | (np.diff(at // CHUNK) > 0)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                    begin, end = int(low[a:b].min()), int(high[a:b].max())
                    rows.append((key.as_py(), begin, keys_of(g[a:b], words[begin:end]).view(np.int64), words[begin:end].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    passages = stored(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, schema), "passages")
    keyed = passages.select("id", "start", F.explode("keys").alias("key"))
    pairs = keyed.join(seeds.hint("merge"), "key").select("id", "start", "item").distinct()
    asked = pairs.join(items.select("item", F.col("words").alias("item_words")).hint("merge"), "item")
    ready = asked.join(passages.select("id", "start", "words").distinct().hint("merge"), ["id", "start"])

    def make():
        def step(batch):
            out = {k: [] for k in ("id", "item_id", "score", "start", "end")}
            for key, start, item, item_words, words in zip(*(batch.column(k) for k in range(5)), strict=True):
                a, b = (np.asarray(x.values) for x in (item_words, words))
                if np.isin(a, b).sum() < least_score * len(a):
                    continue
                # A passage may be wider than this item needs: the parts around its own seeds are aligned.
                at = np.flatnonzero(np.isin(grams(b.view(np.uint64), min(n, len(a))), grams(a.view(np.uint64), n)))
                far = reach(len(a))
                ends = np.maximum.accumulate(at + n + far)
                cut = np.flatnonzero(at[1:] - far > ends[:-1]) + 1
                for part in np.split(at, cut):
                    if not len(part):
                        continue
                    begin = max(0, int(part[0]) - far)
                    around = b[begin : int(part[-1]) + n + far]
                    if np.isin(a, around).sum() < least_score * len(a):
                        continue
                    best, low, high = align(a, around)
                    score = best / (MATCH * len(a))
                    if score >= least_score:
                        for name, v in zip(out, (key.as_py(), item.as_py(), score, start.as_py() + begin + low, start.as_py() + begin + high), strict=True):
                            out[name].append(v)
            return out

        return step

    found = arrow_map(
        ready.select("id", "start", "item", "item_words", "words"), make, f"id {kind}, item_id {dict(items.dtypes)['item']}, score double, start long, end long"
    )
    best = found.groupBy("id", "item_id").agg(F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.score", "b.start", "b.end")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without those that hold a passage of the benchmark; rows with a null id stay."""
    bad = stored(contaminated(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "contaminated")
    return docs.join(bad.hint("merge"), id_col, "left_anti")
