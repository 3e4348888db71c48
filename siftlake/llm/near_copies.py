"""Near copies among whole documents: the SimHash index and MinHash bands find candidates, exact Jaccard decides.

The groups of ``simhash`` (fingerprints within four bits, by its index) are collisions like those of a band. Its index of eight
byte positions guarantees matches within seven bits at most, while texts of similarity 0.8 differ in about ten; so eight
MinHash bands of three rows, which find a pair of similarity 0.8 with probability 0.997, stand beside it. Collisions,
verification and classes are those of ``paragraphs``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import simhash
from siftlake.llm.common import arrow_map, stored, texts_of
from siftlake.llm.components import connected_components
from siftlake.llm.decontaminate import places, sized_filter
from siftlake.llm.paragraphs import SEEN, Seen, colliding, hash_columns, text_classes, whole_texts


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col`` and ``component_id`` (the least id of its group) for each row with an id.

    Two texts are linked if the sets of their runs of ``size`` words (lower case, any white space) have at least
    that Jaccard similarity. Texts of the same words are linked, also those without words (null and empty too).
    """
    kind = dict(docs.dtypes)[id_col]
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def signed():
        seen = Seen()

        def step(batch):
            texts = list(texts_of(batch.column(1)))
            hashes, keys = whole_texts(texts, size)
            fps = np.array([simhash.fingerprint(t.encode()) for t in texts], dtype=np.uint64).view(np.int64)
            return {"id": batch.column(0), "fp": fps} | hash_columns(hashes) | seen.news(hashes, keys)

        return step

    def words_for(near: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(sized_filter(near.select(F.col("k").alias("g"))))

        def make():
            bits, seen = shared.value, set()

            def step(batch):
                texts, out = list(texts_of(batch.column(0))), {"h": [], "words": []}
                hashes, _ = whole_texts(texts, size)
                for j in places(hashes[:, 0], bits).tolist():
                    h = hashes[j].tobytes()
                    if h not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(h)
                        out["h"].append(h)
                        out["words"].append(" ".join(texts[j].lower().split()))
                return out

            return step

        return arrow_map(named.select("text"), make, "h binary, words string").dropDuplicates(["h"])

    rows = stored(arrow_map(named, signed, f"id {kind}, fp long, h binary, k long, bands array<long>, sure array<long>, again boolean"), "signed")
    printed = stored(rows.select("fp", "k").distinct(), "fingerprints")
    groups = connected_components(simhash.near_links(printed.select("fp").distinct()))
    group = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key")
    alike = colliding(printed.join(groups.hint("merge"), F.col("fp") == F.col("node"), "left").select(group, "k"))
    _, of_text = text_classes(rows.drop("fp"), words_for, order=["id"], size=size, similarity=similarity, more=alike)
    return rows.join(of_text.hint("merge"), "h", "left").select(F.col("id").alias(id_col), F.coalesce("least.id", "id").alias("component_id"))
