"""Exact duplicates: a blocked Bloom filter of repeated hashes decides which rows shuffle at all.

Pass one hashes every text and counts the filter cells that its hash sets; the cells set by
two rows or more become bitmaps. Pass two tests every row against the bitmaps: a row with a
cell that no other row sets has no equal and passes straight through. Only the others are
grouped, by the SHA-256 of their text, and of these just keys and ids move, never texts.

Cases: a null text counts as empty, and empty texts are equal. Of equal texts the row with the
largest id stays; a null id counts as smaller than any other, and rows that repeat both
text and id are the same document and get the same answer (``deduplicate`` returns one of them).
An empty table gives an empty result. Further columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.bloom import bitmaps, filter_blocks, tested
from lodgeframe.llm.storage import stored
from lodgeframe.llm.textarrays import ascii_lower

def duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``df`` with _text_sha256, _keep_id, _group_size and _kept.

    The filter hashes texts in full lower case, which is quick and never parts texts that are
    equal but for A-Z; the groups are by the SHA-256 of the text with only A-Z in lower case.
    """
    added = ["_text_sha256", "_keep_id", "_group_size", "_kept"]
    if clash := {"_h", "_block", "_bitmap", *added} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are used by this operator")
    hashed = F.xxhash64(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    sha = F.sha2(ascii_lower(F.col(f"`{text}`")), 256)
    blocks = filter_blocks(df.select(F.lit(1)).count())
    repeated = bitmaps(df.select(hashed.alias("h")), blocks, least=2)
    marked, possible = tested(df, hashed, repeated, blocks)
    own = [f"`{c}`" for c in df.columns]
    single = marked.where(~possible).select(
        *own,
        sha.alias("_text_sha256"),
        F.col(f"`{key}`").alias("_keep_id"),
        F.lit(1).cast("long").alias("_group_size"),
        F.lit(True).alias("_kept"),
    )
    several = marked.where(possible).select(*own, sha.alias("_text_sha256"))
    groups = several.groupBy("_text_sha256").agg(
        F.max(f"`{key}`").alias("_keep_id"), F.count(F.lit(1)).alias("_group_size")
    )
    # Stored, so that the join reads both sides from plain exchanges: only then does Spark split a hot group's partition.
    groups = stored(groups, "groups")
    kept = F.col(f"`{key}`").eqNullSafe(F.col("_keep_id"))
    joined = several.join(groups, "_text_sha256").select(*own, *added[:-1], kept.alias("_kept"))
    return single.unionByName(joined)


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``df``: one for each distinct text."""
    found = duplicates(df, text, key).where("_kept")
    single = found.where("_group_size = 1").select(*[f"`{c}`" for c in df.columns])
    several = found.where("_group_size > 1").dropDuplicates(["_text_sha256"]).select(*[f"`{c}`" for c in df.columns])
    return single.unionByName(several)
