"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice has a node for each boundary between characters and an edge for each piece. For a BPE
vocabulary an edge may follow another just if the two pieces, encoded together, come out as these two
again; BPE merges are local, so a path all of whose neighbours are so compatible is the BPE encoding,
and each boundary has one surviving path. For a unigram vocabulary the path with the best sum of
scores survives. Either way only a window of boundaries as wide as the longest piece can still be
reached; ids are committed, and the rest forgotten, whenever all surviving backpointer paths run
through one boundary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftlake.llm.common import arrow_schema

SPACE = "▁"
#: Segments of up to this many characters are kept with their ids; longer ones come in parts.
KEPT_CHARS = 48
PART = 4096
KEPT = 1_000_000
#: Pieces whose followers are kept.
PAIRS = 60_000
#: A worker's codec, kept between tasks with what it has encoded so far.
_OWN: dict[str, Codec] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by string; ``bytes_ids`` are the ids of the 256 byte pieces (empty: no byte fallback)."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    unknown: int
    surfaces: tuple[bytes, ...]  # by id
    bpe: bool = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The pieces of a model file with dummy prefix, kept white space and no character map.

        The scores of a BPE model are whole numbers, the order of its merges; others are a unigram model's.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, surfaces, byte_ids = {}, {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                surfaces.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i):
                surfaces.append(b"")
            elif model.is_unknown(i):
                surfaces.append(" ⁇ ".encode())
            else:
                ids[piece], scores[piece] = i, model.get_score(i)
                surfaces.append(piece.replace(SPACE, " ").encode())
        bpe = all(float(x).is_integer() for x in scores.values())
        return cls(ids, scores, tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (), model.unk_id(), tuple(surfaces), bpe)


class Codec:
    """Encodes and decodes texts. ``encode_stream`` takes a text in parts of any size."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.ids), default=1)
        #: Beginnings of pieces, and whether they are pieces themselves.
        self.trie = {p[:n]: False for p in vocabulary.ids for n in range(1, len(p))}
        self.trie.update(dict.fromkeys(vocabulary.ids, True))
        self.pairs: dict[str, dict[str, bool]] = {}
        self.steps: dict[str, list | None] = {}
        self.known: dict[str, bytes] = {}
        # If no piece has a space mark after another character, no edge crosses the boundary before one.
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p in vocabulary.ids)
        self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: Neighbouring characters within a piece. Between other neighbours every path has a boundary.
        self.inner = {p[k : k + 2] for p in vocabulary.ids for k in range(len(p) - 1)}
        self.least = min(vocabulary.scores.values(), default=0.0) - 10.0  # of a character that is no piece

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """BPE of a short string, and each step's score with the first and last parts after it.

        The best-scored neighbouring pair is joined first, the leftmost among equals.
        """
        parts, scores, steps = list(text), self.v.scores, []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The steps that make a piece; none if BPE does not make it."""
        if piece not in self.steps:
            parts, steps = self.merged(piece)
            self.steps[piece] = [*steps, (-math.inf, piece, piece)] if parts == [piece] else None
        return self.steps[piece]

    def compatible(self, before: str, piece: str) -> bool:
        """Whether ``piece`` can follow ``before`` ("" at the start of a text) in a BPE encoding."""
        fits = self.pairs.setdefault(before, {})
        if piece not in fits:
            fits[piece] = self._compatible(before, piece)
        return fits[piece]

    def _compatible(self, before: str, piece: str) -> bool:
        """Both pieces are made side by side, the better-scored step first, until a join across them would come first."""
        right = self.history(piece)
        left = self.history(before) if before else right
        if right is None or left is None:
            return False
        if not before:
            return True
        i, j, x, y, scores = 0, 0, before[-1], piece[0], self.v.scores
        while True:
            a, b = left[i][0], right[j][0]
            across = scores.get(x + y)
            if across is not None and across >= a and across >= b:
                return False if across > a and across > b else self.merged(before + piece)[0] == [before, piece]
            if a == b == -math.inf:
                return True
            if a >= b:
                x = left[i][2]
                i += 1
            else:
                y = right[j][1]
                j += 1

    def committed(self, parts: Iterable[str]) -> Iterator[list[str]]:
        """Pieces of a normalised text that comes in parts, in runs that are committed as soon as they are certain.

        ``window`` holds the text from the last committed boundary on. A boundary is gone on from once all pieces that
        may begin there are in the window; it is committed where no edge crosses it, or else, in a window of four
        longest pieces, at the last boundary that the backpointer paths of all live boundaries run through.
        """
        longest, trie, pairs, bpe, scores, least = self.longest, self.trie, self.pairs, self.v.bpe, self.v.scores, self.least
        window, starts, last, totals = "", [0], [""], {0: 0.0}  # for each boundary of the window: its last piece, the path's score
        at, reach, certain, size = 0, 0, 0, 0  # the next boundary to go on from; the farthest one reached so far; the last one committed
        wide = 4 * longest

        for part in chain(parts, (None,)):
            if part is not None:
                if certain > wide:  # forget what is committed
                    window, starts, last = window[certain:], [max(0, s - certain) for s in starts[certain:]], last[certain:]
                    totals = {b - certain: t for b, t in totals.items() if b >= certain}
                    at, reach, certain = at - certain, reach - certain, 0
                window += part
                size = len(window)
                starts += [0] * len(part)
                last += [None] * len(part)
                until = size - longest + 1
            else:
                until = size
            while at < until:
                before = last[at]
                if before is None:
                    at += 1
                    continue
                if reach <= at or at - certain >= wide:
                    done = at if reach <= at else self.meeting(at, starts, last)
                    if done > certain:
                        yield self.path(certain, done, starts, last)
                        certain = done
                if bpe:
                    fits = pairs.get(before)
                    if fits is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        fits = pairs[before] = {}
                    end, stop = at + 1, at + longest if at + longest < size else size
                    piece = window[at:end]
                    whole = True  # a single character may always stand alone
                    while True:
                        if whole and last[end] is None:
                            good = fits.get(piece)
                            if good is None:
                                good = fits[piece] = self._compatible(before, piece)
                            if good:
                                starts[end], last[end] = at, piece
                                if end > reach:
                                    reach = end
                        if end == stop:
                            break
                        end += 1
                        piece = window[at:end]
                        whole = trie.get(piece)
                        if whole is None:
                            break
                else:
                    for end in range(at + 1, min(at + longest, size) + 1):
                        piece = window[at:end]
                        whole = trie.get(piece)
                        if whole is None and end > at + 1:
                            break
                        total = totals[at] + scores.get(piece, least)
                        if (whole or end == at + 1) and (last[end] is None or total > totals[end]):
                            starts[end], last[end], totals[end] = at, piece, total
                            reach = max(reach, end)
                at += 1
        yield self.path(certain, size, starts, last)

    @staticmethod
    def path(begin: int, end: int, starts: list[int], last: list[str]) -> list[str]:
        """The pieces on the path from one boundary to another."""
        out = []
        while end > begin:
            out.append(last[end])
            end = starts[end]
        return out[::-1]

    @staticmethod
    def meeting(at: int, starts: list[int], last: list[str | None]) -> int:
        """The last boundary that the paths of all live boundaries run through."""
        ends = {b for b in range(at, len(last)) if last[b] is not None}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(starts[top])
        return ends.pop()

    def pieces_of(self, parts: Iterable[str]) -> Iterator[str]:
        """Pieces of a normalised text that comes in parts."""
        return chain.from_iterable(self.committed(parts))

    def cut(self, segment: str) -> list[str]:
        """A segment cut at the boundaries that all paths have."""
        inner = self.inner
        ends = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in inner]
        return [segment[i:j] for i, j in zip([0, *ends], [*ends, len(segment)], strict=True)] if ends else [segment]

    def ids_of_part(self, text: str) -> bytes:
        """Ids of a string between two certain boundaries; those of short ones are kept for the next time."""
        got = self.known.get(text)
        if got is None:
            parts = (text[k : k + PART] for k in range(0, len(text), PART))
            got = np.array([i for p in self.pieces_of(parts) for i in self.ids_of_piece(p)], dtype=np.int32).tobytes()
            if len(text) <= KEPT_CHARS:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[text] = got
        return got

    def ids_of_piece(self, piece: str) -> list[int]:
        got = self.v.ids.get(piece)
        if got is not None:
            return [got]
        return [self.v.byte_ids[b] for b in piece.encode()] if self.v.byte_ids else [self.v.unknown]

    def encode_stream(self, parts: Iterator[str]) -> Iterator[int]:
        """Ids of a text that comes in parts (dummy prefix added, spaces marked)."""

        def normalised() -> Iterator[str]:
            first = True
            for part in parts:
                if part:
                    yield (SPACE if first else "") + part.replace(" ", SPACE)
                    first = False

        for piece in self.pieces_of(normalised()):
            yield from self.ids_of_piece(piece)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Segments between certain boundaries all go through ``committed``; short ones are encoded once and kept."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        if not self.cuts_at_space:
            return np.fromiter(self.encode_stream(iter([text])), dtype=np.int32)
        known, out = self.known, []
        for segment in self.segment.findall(SPACE + text.replace(" ", SPACE)):
            got = known.get(segment)
            if got is None:
                got = b"".join(map(self.ids_of_part, self.cut(segment)))
                if len(segment) <= KEPT_CHARS:
                    known[segment] = got
            out.append(got)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, the dummy prefix goes."""
        text = b"".join(map(self.v.surfaces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def own_codec(vocabulary: Vocabulary) -> Codec:
    """The worker's codec for a vocabulary (by value, not by place, since each task unpacks its own)."""
    name = f"{hash(tuple(vocabulary.ids.items()))}:{vocabulary.bpe}:{vocabulary.byte_ids[:1]}"
    if name not in _OWN:
        _OWN.clear()
        _OWN[name] = Codec(vocabulary)
    return _OWN[name]


def encode(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``ids``, ``n_ids`` and ``round_trip`` (the ids decode to the text again).

    A null or empty text has no ids and round-trips to the empty text. The mark U+2581 in a text is
    read as a space, as by the library, and so does not round-trip. Repeated rows each give a row;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>, n_ids int, round_trip boolean"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = own_codec(shared.value)
        for batch in batches:
            ids, good = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids.append(codec.encode(text))
                good.append(codec.decode(ids[-1].tolist()) == text)
            sizes = np.array([len(x) for x in ids], dtype=np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat).cast(arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes), pa.array(good)], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``text``. Null ids give the empty text; an id out of range is an error."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"{id_col} {dict(coded.dtypes)[id_col]}, text string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = own_codec(shared.value)
        for batch in batches:
            texts = [codec.decode(v.as_py() or []) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, arrow.field(1).type)], schema=arrow)

    return coded.select(id_col, ids_col).mapInArrow(run, schema)
