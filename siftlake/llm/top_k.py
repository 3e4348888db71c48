"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised to integers and written as blocks of queries and of candidates. Groups of query blocks and groups of
candidate blocks form a grid with about as many cells as tasks: a query travels to each group of candidates once, a candidate to each
group of queries. The task of a cell holds its queries, and sorts each dimension of a candidate block once. For a query the lists are read from their favourable ends, level by level; vectors seen
for the first time are scored in full, and the block is left as soon as the threshold - the score an
unseen vector could have at most - falls below the query's k-th score so far. Where a level brings a quarter of
the block or more, all of the block's scores are computed at once, which is cheaper than picking out its new vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_schema, session, stored

BLOCK = 8192
LEVELS = (16, 64, 256, 1024, 4096)
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (long array, floor(scale * x)); rows with a null or non-finite part are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")
    )


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists, shorter ones padded with zeros, as long."""
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(lengths)), lengths)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which inner products of the rows are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Best:
    """The k best of each query so far: by score, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, dtype=np.int64)] * n
        self.ids = [np.zeros(0, dtype=np.int64)] * n
        self.bound = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bound[q]
        if not good.any():
            return
        s, i = np.concatenate((self.scores[q], scores[good].astype(np.int64))), np.concatenate((self.ids[q], ids[good]))
        if len(s) > 8 * self.k:  # a cut by score first, all ties kept
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[keep], i[keep]
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.bound[q] = s[order[-1]]


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the rows in the order of their values, and these values."""
    order = np.argsort(x, axis=0, kind="stable")
    return order, np.take_along_axis(x, order, axis=0)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best, lists: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Run all queries over one block of candidates (its sorted ``lists``, if they are made already); returns how many vectors were scored."""
    kind = exact_type(x, queries)
    order, values = lists or sorted_lists(x)
    x, queries, values = x.astype(kind), queries.astype(kind), values.astype(kind)
    n, dim = x.shape
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    levels = [d for d in LEVELS if d < n] + [n]
    # Threshold of each query after each level, from the last values read.
    limits = np.stack([up @ values[n - d] + down @ values[d - 1] for d in levels], axis=1)
    scored = 0
    own = {int(v): k for k, v in enumerate(query_ids)}
    same: dict[int, list[int]] = {}
    for row, v in enumerate(ids.tolist()):
        if v in own:
            same.setdefault(own[v], []).append(row)
    for q in range(len(query_ids)):
        used_up, used_down = np.flatnonzero(queries[q] > 0), np.flatnonzero(queries[q] < 0)
        if not len(used_up) and not len(used_down):
            levels_of_q, done = [n], np.zeros(n, dtype=bool)
        else:
            levels_of_q, done = levels, np.zeros(n, dtype=bool)
        done[same.get(q, [])] = True  # never the query's own row
        before = 0
        for level, depth in enumerate(levels_of_q):
            if depth == n:
                new = np.flatnonzero(~done)
            else:
                seen = np.zeros(n, dtype=bool)
                seen[order[n - depth : n - before, used_up]] = True
                seen[order[before:depth, used_down]] = True
                new = np.flatnonzero(seen & ~done)
            if len(new):
                scores = x @ queries[q] if len(new) * 4 > n else x[new] @ queries[q]
                best.add(q, scores[new] if len(scores) == n else scores, ids[new])
                done[new] = True
                scored += len(new)
            if depth == n or limits[q, level] < best.bound[q]:
                break
            before = depth
    return scored


def grid(query_blocks: int, candidate_blocks: int, tasks: int) -> tuple[int, int]:
    """Groups of query blocks and groups of candidate blocks."""
    across = max(1, -(-query_blocks // HELD))
    return across, max(1, min(candidate_blocks, -(-tasks // across)))


_BLOCK = "block long, ids binary, vectors binary, dim int, rows int"


def _packed(ids: list[np.ndarray], lists: list[pa.Array], block: int) -> dict:
    dim = max([1, *(int(np.asarray(v.value_lengths()).max(initial=0)) for v in lists)])
    x = np.concatenate([matrix(v, dim) for v in lists])
    for kind in (np.int16, np.int32):
        if np.abs(x).max(initial=0) <= np.iinfo(kind).max:
            x = x.astype(kind)
            break
    return {"block": block, "ids": np.concatenate(ids).tobytes(), "vectors": x.tobytes(), "dim": dim, "rows": len(x)}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    cells = row["rows"] * row["dim"]
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["vectors"], dtype=f"i{len(row['vectors']) // max(cells, 1)}").reshape(row["rows"], row["dim"]).astype(np.int64)


def packed(rows: DataFrame, size: int, block_col: str | None = None) -> DataFrame:
    """One row per block of at most ``size`` vectors: of the rows of a task as they come, or of those of one ``block_col``."""
    arrow = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        lists: list[pa.Array] = []
        block = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if ids:
                made = _packed(ids, lists, number if block is None else block)
                number += 1
                ids.clear()
                lists.clear()
                yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2).to_numpy() if block_col else np.zeros(batch.num_rows, dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if block_col and column[begin] != block:
                    yield from flush()
                    block = int(column[begin])
                while begin < end:
                    part = batch.slice(begin, min(end - begin, size - sum(map(len, ids))))
                    ids.append(part.column(0).to_numpy())
                    lists.append(part.column(1))
                    begin += part.num_rows
                    if sum(map(len, ids)) == size:
                        yield from flush()
        yield from flush()

    return rows.select("vec_id", "v", *([F.col(block_col).cast("long")] if block_col else [])).mapInArrow(run, _BLOCK)


def _search(cells: DataFrame, k: int) -> DataFrame:
    """The k best of each query over the candidates of its cell. Rows come by cell, its blocks of queries (``role`` 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, []

        def told() -> Iterator[pa.RecordBatch]:
            for own_ids, _, best in asked:
                counts = [len(i) for i in best.ids]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own_ids, counts)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], schema=_SCHEMA
                    )

        for batch in batches:
            for n in range(batch.num_rows):
                row = {f.name: batch.column(j)[n].as_py() for j, f in enumerate(batch.schema)}
                if row["cell"] != cell:
                    yield from told()
                    cell, asked = row["cell"], []
                ids, x = _unpacked(row)
                if row["role"] == 0:
                    asked.append((ids, x, Best(len(ids), k)))
                    continue
                lists = None
                for own_ids, own, best in asked:
                    if own.shape[1] > x.shape[1]:
                        x, lists = np.pad(x, ((0, 0), (0, own.shape[1] - x.shape[1]))), None
                    lists = lists or sorted_lists(x)
                    search_block(ids, x, own_ids, np.pad(own, ((0, 0), (0, x.shape[1] - own.shape[1]))), best, lists)
        yield from told()

    return cells.mapInArrow(run, "query_id long, vec_id long, score long")


#: Query blocks that a task holds.
HELD = 8


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = 4096,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best candidates of each query.

    Queries are the rows where ``is_query`` holds; candidates are all rows but those with the query's own
    id. Scores are integer inner products of floor(scale * x); ties go to the smaller id. Rows with a null
    id, vector or part, or a non-finite part, take no part; shorter vectors count as padded with zeros.
    A repeated candidate row is a candidate each time, a repeated query row one query (of rows with one
    id, the least vector asks). Scores must fit in a long. Other columns are ignored.

    Queries and candidates are written as tables of blocks (about ``query_block`` and at most ``block`` vectors). With Q groups of
    about ``HELD`` query blocks and C groups of candidate blocks, Q x C about the number of tasks, a vector is shuffled Q or C times.
    No vector comes to the driver, whatever the numbers.
    """
    spark = session(vectors.sparkSession)
    rows = quantised(vectors, scale, id_col, vector_col)
    asking = stored(quantised(vectors.where(is_query), scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    asked = max(1, -(-asking.count() // query_block))
    dealt = asking.withColumn("of", F.pmod(F.xxhash64("vec_id"), F.lit(asked))).repartition(asked, "of").sortWithinPartitions("of")
    # A block may come in several rows where its hash has more than its share: each is a block of its own.
    queries = stored(packed(dealt, 2 * query_block, "of"), "query-blocks")
    candidates = stored(packed(rows, block), "candidate-blocks")
    across, down = grid(queries.count(), candidates.count(), 4 * spark.sparkContext.defaultParallelism)
    fields = ["block", "ids", "vectors", "dim", "rows"]
    groups = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("block", "ids"), F.lit(n)).cast("int")
    left = queries.select(mine(across).alias("a"), groups(down).alias("b"), F.lit(0).alias("role"), *fields)
    right = candidates.select(groups(across).alias("a"), mine(down).alias("b"), F.lit(1).alias("role"), *fields)
    cells = left.unionByName(right).withColumn("cell", F.col("a") * down + F.col("b"))
    found = _search(cells.repartition(across * down, "cell").sortWithinPartitions("cell", "role").select("cell", "role", *fields), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
