"""Token counts without ids: pieces are counted once per distinct pre-token.

1. Tasks cut texts into pre-tokens and write, per block of documents and share of the vocabulary, one
   row with the distinct pre-tokens and their postings (which document of the block, how often).
2. Rows are dealt by the share and a group of blocks (those of 64 tasks, some GB of text), so that a pre-token of
   all documents is spread over the groups. A task counts the pieces of each pre-token of a share and group once,
   multiplies them into the postings and sums per document.
3. The sums of a block's documents are dealt by block and added up.

Ids are never made. A pre-token's string crosses the network once a block, not once a document, and
rows are compressed, so the shuffle stays well below the input.
"""

from __future__ import annotations

import json
import os
import pickle
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_schema, texts_of

BLOCK_ROWS = 1 << 15
#: Tasks of the first step whose postings of one pre-token meet in one task of the second.
TASKS = 64
BLOCK_CHARS = 24_000_000
#: Pre-tokens that a task keeps with their numbers of pieces.
KEPT = 1_000_000


def ranges(points: list[int]) -> str:
    """A bracket expression's inside for sorted code points."""
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def classes() -> dict[str, str]:
    """Letters, numbers and white space of Unicode as ranges; Python's own ``\\s`` and ``\\w`` differ from these groups."""
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    for c in range(0x110000):
        kinds.setdefault(unicodedata.category(chr(c))[0], []).append(c)
    space = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    return {r"\p{L}": ranges(kinds["L"]), r"\p{N}": ranges(kinds["N"]), r"\s": ranges(space)}


class PreTokens:
    """The library's normaliser and splitter for word BPE files, whose pre-tokens are encoded one by one.

    Special strings are cut from the raw text first, each one a pre-token, as the library does.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = {t["content"] for t in made["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special))  # without it there is no special string
        split = next(p for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        for group, members in classes().items():
            pattern = pattern.replace(group, members)  # the files use the groups inside brackets only
        self.find = re.compile(pattern).findall
        self.lower = any(n["type"] == "Lowercase" for n in made["normalizer"]["normalizers"])

    def _words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final form of sigma
        return self.find(text)

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or self.mark not in text:
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._words(part)
        return out


def piece_counter(tokenizer_path: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    made = Tokenizer.from_file(tokenizer_path)
    made.no_truncation()
    made.no_padding()
    made.normalizer = normalizers.Sequence([])  # words come normalised and cut
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return lambda words: [len(e.ids) for e in made.encode_batch(words, add_special_tokens=False)]


def packed(found: dict[str, list[int]], words: list[str]) -> bytes:
    """Words and their postings. Words hold no white space; a posting is the place and the frequency."""
    parts = ["\n".join(words).encode()]
    lists = [found[w] for w in words]
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64)
    sizes = np.fromiter(map(len, lists), dtype=np.uint32, count=len(lists)) // 2
    parts += [sizes.tobytes(), flat[::2].astype(np.uint16).tobytes(), flat[1::2].astype(np.uint32).tobytes()]
    return pickle.dumps([zstandard.compress(p, 3) for p in parts])


def unpacked(payload: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    text, *arrays = map(zstandard.decompress, pickle.loads(payload))  # noqa: S301  written by ``packed`` in this job
    sizes, places, counts = (np.frombuffer(x, dtype=t) for x, t in zip(arrays, (np.uint32, np.uint16, np.uint32), strict=True))
    return text.decode().split("\n"), sizes, places, counts


def postings(docs: DataFrame, tokenizer_path: str, shares: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: with ``share`` -1 the ids and byte sizes of a block's documents, else postings."""
    schema = f"block long, share int, payload binary, ids array<{dict(docs.dtypes)[id_col]}>, sizes array<bigint>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = PreTokens(tokenizer_path)
        block = (TaskContext.get().partitionId() << 24) - 1  # the same again if the task is run again
        ids: list = []
        sizes: list[int] = []
        found: defaultdict[str, list[int]] = defaultdict(list)
        chars = 0

        def flush() -> pa.RecordBatch:
            by_share: dict[int, list[str]] = {}
            for word in found:
                by_share.setdefault(zlib.crc32(word.encode()) % shares, []).append(word)
            rows = [packed(found, sorted(words)) for words in by_share.values()]
            n = len(rows) + 1
            columns = [[block] * n, [-1, *by_share], [None, *rows], [ids] + [None] * (n - 1), [sizes] + [None] * (n - 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                row = len(ids)
                ids.append(key)
                sizes.append(len(text.encode()))
                chars += len(text)
                for word, n in Counter(cut(text)).items():
                    found[word] += (row, n)
                if len(ids) == BLOCK_ROWS or chars >= BLOCK_CHARS:
                    block += 1
                    yield flush()
                    ids, sizes, found, chars = [], [], defaultdict(list), 0
        if ids:
            block += 1
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sums_of_shares(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Tokens per document of a block from the pre-tokens of a task's shares; rows with ids pass through."""
    schema = "block long, sums binary, " + ", ".join(f"{c} {t}" for c, t in rows.select("ids", "sizes").dtypes)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(tokenizer_path)
        known: dict[str, int] = {}
        block, own, sums = None, None, np.zeros(0, dtype=np.int64)

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([zstandard.compress(sums.astype(np.int64).tobytes(), 3)]), *(pa.nulls(1, f.type) for f in list(arrow)[2:])],
                schema=arrow,
            )

        for batch in batches:
            heads = pc.equal(batch.column(1), -1)
            some = batch.filter(heads)
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([some.column(0), pa.nulls(some.num_rows, arrow.field(1).type), some.column(3), some.column(4)], schema=arrow)
            for b, share, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                if share.as_py() == -1:
                    continue
                if (b.as_py(), share.as_py()) != (block, own):
                    if block is not None:
                        yield summed()
                    if share.as_py() != own:
                        known.clear()  # no other share holds these pre-tokens
                    block, own, sums = b.as_py(), share.as_py(), np.zeros(0, dtype=np.int64)
                words, sizes, places, counts = unpacked(payload.as_py())
                new = [w for w in words if w not in known]
                if new:
                    if len(known) + len(new) > KEPT:
                        known.clear()
                        new = words
                    known.update(zip(new, count(new), strict=True))
                pieces = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                got = np.bincount(places, np.repeat(pieces, sizes) * counts, minlength=len(sums)).astype(np.int64)
                got[: len(sums)] += sums
                sums = got
        if block is not None:
            yield summed()

    return rows.select("block", "share", "payload", "ids", "sizes").mapInArrow(run, schema)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, shares: int | None = None
) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null text counts as empty (0 bytes, 0 tokens). Null ids and repeated rows each give a row of
    their own: documents are told apart by their place in a block. Other columns are ignored.
    ``shares`` of the vocabulary, by default the session's shuffle partitions, set how many tasks count.
    """
    spark = docs.sparkSession
    shares = shares or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = postings(docs, tokenizer_path, shares, id_col, text_col)
    group = F.shiftright("block", 24 + TASKS.bit_length() - 1)
    dealt = rows.repartition(shares, "share", group).sortWithinPartitions("share", "block")
    partial = sums_of_shares(dealt, tokenizer_path).repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, total = None, None, None, np.zeros(0, dtype=np.int64)

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(total), pa.array(total > limit)], schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                b, payload = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if b != block:  # the first row of a block holds its ids
                    if block is not None:
                        yield finished()
                    block = b
                    ids, sizes = (batch.column(j)[k].values.cast(t) for j, t in ((2, arrow.field(0).type), (3, arrow.field(1).type)))
                    total = np.zeros(len(ids), dtype=np.int64)
                else:
                    part = np.frombuffer(zstandard.decompress(payload), dtype=np.int64)
                    total[: len(part)] += part
        if block is not None:
            yield finished()

    return partial.mapInArrow(run, schema)
