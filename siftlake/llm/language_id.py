"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts. A text is encoded with
every dictionary in blocks; the language whose dictionary gives the fewest bytes wins. The relative
margin between the best and the second-best size tells how sure that is.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftlake.llm.common import texts_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language. Its size is bounded by languages x ``dictionary_bytes``."""

    dictionaries: dict[str, bytes]
    block_bytes: int = 4096
    sharpness: float = 60.0


def fit(
    docs: DataFrame,
    *,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 48,
    dictionary_bytes: int = 65_536,
    prefer_bytes: int = 16_384,
) -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows.

    At most ``sample_rows`` distinct rows of each language are used (rows of up to ``prefer_bytes`` first, then
    in the order of a hash of the id), and a dictionary holds at most ``dictionary_bytes``. A text of more than
    ``dictionary_bytes / 4`` characters, used only where shorter ones are few, gives eight pieces of that length
    together, spread evenly over it; what reaches the driver is bounded by languages x ``sample_rows`` x
    ``dictionary_bytes``. Rows whose text, language or id is null take no part; repeated rows count once. Without
    rows there are no languages and all texts are undetermined.
    """
    rows = docs.where(usable if usable is not None else F.lit(True)).where(
        F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    )
    keys = rows.select(
        F.col(id_col).alias("_id"),
        F.col(lang_col).alias("_lang"),
        (F.octet_length(text_col) > prefer_bytes).alias("_long"),
        F.xxhash64(F.col(id_col).cast("string")).alias("_h"),
        F.xxhash64(F.col(id_col).cast("string"), lang_col, text_col).alias("_x"),
    )
    order = Window.partitionBy("_lang").orderBy("_long", "_h", "_id", "_x")
    first = keys.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= sample_rows)  # equal rows have one rank
    places = {r[0]: (r[1], r[2]) for r in first.select("_x", "_lang", "_n").distinct().collect()}  # languages x sample_rows keys
    share = max(8, dictionary_bytes // 4)
    spread = [F.substring(F.col("_t"), (F.lit(1) + F.floor((F.length("_t") - share // 8) * k / 7)).cast("int"), F.lit(share // 8)) for k in range(8)]
    sample: dict[str, dict[int, bytes]] = {}
    if places:
        made = rows.select(F.xxhash64(F.col(id_col).cast("string"), lang_col, text_col).alias("_x"), F.col(text_col).alias("_t")).where(F.col("_x").isin(list(places)))
        for x, text in made.select("_x", F.when(F.length("_t") <= share, F.col("_t")).otherwise(F.concat_ws(" ", *spread)).alias("_t")).dropDuplicates(["_x"]).collect():
            lang, n = places[x]
            sample.setdefault(lang, {})[n] = letters_of(text).encode()
    return LanguageModel(
        {lang: b" ".join(t for _, t in sorted(parts.items(), reverse=True))[-dictionary_bytes:] for lang, parts in sorted(sample.items())}
    )


#: Case, digits and signs say nothing of the language.
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """Lower-case letters with single spaces between; empty for a text without a letter."""
    found = NOT_LETTERS.sub(" ", text.lower()).strip()
    if found and not found.replace(" ", "").isalpha():  # signs for numbers, such as a half or a raised two, are no letters either
        found = " ".join("".join(c if c.isalpha() else " " for c in found).split())
    return found


class Encoder:
    """Encoded sizes of a text under each dictionary of a model."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.langs = list(model.dictionaries)
        self.by_lang = []
        for content in model.dictionaries.values():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                9, dict_size=len(content), source_size=model.block_bytes, min_match=3, strategy=zstandard.STRATEGY_GREEDY, search_log=3,
                write_content_size=False, write_dict_id=False,
            )  # short matches: words' endings tell languages apart
            made.precompute_compress(compression_params=how)
            self.by_lang.append(zstandard.ZstdCompressor(dict_data=made, compression_params=how))

    def sizes(self, letters: str) -> list[int]:
        data, step = letters.encode(), self.model.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by_lang]

    def decide(self, text: str) -> tuple[str, float, float]:
        """Language, score (share of the winner when sizes are turned into odds) and relative margin."""
        letters = letters_of(text)
        if not self.langs or not letters:
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(letters)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        least = sizes[best]
        odds = [math.exp(-self.model.sharpness * (s - least) / least) for s in sizes]
        others = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(others) - least) / min(others) if others else 1.0
        return self.langs[best], 1.0 / sum(odds), margin


def identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", min_margin: float = 0.004) -> DataFrame:
    """``docs`` with the columns ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` added, row for row.

    The whole text is encoded. A null text, or one without a letter, is ``und`` with score 0 and is
    rejected; a text whose relative margin is below ``min_margin`` keeps the best language but is
    rejected. Sizes that tie go to the language first in order (margin 0: rejected).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, extra = docs.columns.index(text_col), [("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "margin": F.lit(0.0), "rejected": F.lit(True)}).schema

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            got = [encoder.decide(t) for t in texts_of(batch.column(place))]
            rows = [(*g, g[0] == UNDETERMINED or g[2] < min_margin) for g in got]
            for k, (name, kind) in enumerate(extra):
                made = pa.array([r[k] for r in rows], kind)
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, name, made) if at >= 0 else batch.append_column(name, made)
            yield batch

    return docs.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in schema]))


def identify(
    docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.004
) -> DataFrame:
    """``identified`` with the id alone: one row per input row, repeated rows included; other columns are ignored."""
    return identified(docs.select(id_col, text_col), model, text_col=text_col, min_margin=min_margin).drop(text_col)
