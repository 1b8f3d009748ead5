"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size. Distinct blocks are sorted and numbered; adjacent
numbers of a document are paired, distinct pairs sorted and numbered again, and so on until
each document has one number. Two documents have the same number at the same level only if
their texts are the same, byte for byte: numbers are given to sorted distinct contents, so
nothing can collide.

Blocks are sorted by a 64-bit hash first and by content where hashes tie. Content crosses
the network once, combined before the shuffle; after that only numbers travel. Column
expressions and SQL operators alone.

A block, pair or text may occur in a third of all rows. Those above one row in ``SHARE`` are
fewer than ``SHARE`` by count, so they are broadcast, and their rows meet in no one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rotorwatch.llm.rows import ROW, keyed, same_row, text
from rotorwatch.session import materialize

SHELVES = 1 << 16
SHARE = 1000


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Number distinct rows: shelf by hash, then rank in sorted order on the shelf."""
    shelf = F.pmod(F.xxhash64(*order), F.lit(SHELVES))
    rank = F.row_number().over(Window.partitionBy("_ll_shelf").orderBy(*order))
    out = distinct.withColumn("_ll_shelf", shelf).withColumn("_ll_name", rank.cast("long") * SHELVES + F.col("_ll_shelf"))
    return out.drop("_ll_shelf")


def _looked_up(many: DataFrame, few: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``few``, which has each key once and in ``_ll_rows`` its number of
    rows. Rows of frequent keys are matched by broadcast and go on dealt by ``spread``."""
    total = few.agg(F.sum("_ll_rows")).first()[0] or 0
    value = F.struct(*[c for c in few.columns if c not in (*on, "_ll_rows")])
    often = few.where(F.col("_ll_rows") * SHARE > total).select(*on, value.alias("_ll_often"))
    seldom = few.select(*on, F.lit(-1).cast("long").alias("_ll_deal"), value.alias("_ll_seldom"))
    deal = F.when(F.col("_ll_often").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(SHELVES)))
    out = many.join(F.broadcast(often), on, "left").withColumn("_ll_deal", deal.cast("long"))
    out = out.join(seldom, [*on, "_ll_deal"], "left").withColumn("_ll_value", F.coalesce("_ll_often", "_ll_seldom"))
    return out.where(F.col("_ll_value").isNotNull()).select(*many.columns, "_ll_value.*")


def _blocks(docs, block_bytes, hash_bits):
    count = F.greatest(F.lit(1), F.ceil(F.col("_ll_size") / block_bytes)).cast("int")
    cut = F.transform(F.array(F.col("_ll_text").cast("binary")), lambda b: F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(b, i * block_bytes + 1, block_bytes)
    ))[0]
    rows = docs.select(*ROW, count.alias("_ll_n"), F.posexplode(cut).alias("_ll_pos", "_ll_block"))
    h = F.xxhash64("_ll_block")
    return rows.withColumn("_ll_h", h if hash_bits == 64 else F.pmod(h, F.lit(1 << hash_bits)))


def _first_names(blocks):
    """Numbers for all blocks: (key, n, pos, name)."""
    seen = materialize(
        blocks.groupBy("_ll_h").agg(
            (F.min("_ll_block") != F.max("_ll_block")).alias("_ll_tie"), F.count("*").alias("_ll_rows")
        ), "block-hashes"
    )
    alone = materialize(_numbered(seen.where(~F.col("_ll_tie")).select("_ll_h", "_ll_rows"), "_ll_h"), "block-names")
    at = [*ROW, "_ll_pos"]
    cols = [*ROW, "_ll_n", "_ll_pos", "_ll_name"]
    named = _looked_up(blocks.drop("_ll_block"), alone, ["_ll_h"], at).select(*cols)
    ties = seen.where("_ll_tie")
    if not ties.isEmpty():  # different blocks of one hash: numbered by content, below zero
        tied = blocks.join(ties.select("_ll_h"), "_ll_h", "left_semi")
        names = tied.groupBy("_ll_h", "_ll_block").agg(F.count("*").alias("_ll_rows"))
        names = materialize(_numbered(names, "_ll_h", "_ll_block"), "tied-names")
        tied = _looked_up(tied, names, ["_ll_h", "_ll_block"], at).withColumn("_ll_name", -F.col("_ll_name"))
        named = named.unionByName(tied.select(*cols))
    return named


def _next_names(level):
    """Numbers of adjacent pairs."""
    even, name = F.col("_ll_pos") % 2 == 0, F.col("_ll_name")
    pairs = level.groupBy(*ROW, "_ll_n", F.shiftright("_ll_pos", 1).alias("_ll_pos")).agg(
        F.max(F.when(even, name)).alias("_ll_a"), F.coalesce(F.max(F.when(~even, name)), F.lit(0)).alias("_ll_b")
    )
    names = pairs.groupBy("_ll_a", "_ll_b").agg(F.count("*").alias("_ll_rows"))
    names = materialize(_numbered(names, "_ll_a", "_ll_b"), "pair-names")
    return _looked_up(pairs, names, ["_ll_a", "_ll_b"], [*ROW, "_ll_pos"]).select(
        *ROW, F.ceil(F.col("_ll_n") / 2).cast("int").alias("_ll_n"), "_ll_pos", "_ll_name"
    )


def identities(docs: DataFrame, block_bytes: int = 2048, hash_bits: int = 64,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key of each distinct row with its collision-free identity ``(_ll_level, _ll_name)``.
    ``hash_bits`` under 64 only makes hashes tie more often; results stay the same."""
    rows = keyed(docs, id_col, text_col).select(*ROW, text(text_col).alias("_ll_text"))
    longest = rows.agg(F.max("_ll_size")).first()[0] or 0
    level = materialize(_first_names(_blocks(rows, block_bytes, hash_bits)), "names")
    done, k, blocks = [], 0, max(1, -(-longest // block_bytes))
    while True:
        done.append(level.where("_ll_n = 1").select(*ROW, F.lit(k).alias("_ll_level"), "_ll_name"))
        if blocks == 1:
            break
        level, k, blocks = materialize(_next_names(level.where("_ll_n > 1")), "names"), k + 1, -(-blocks // 2)
    return reduce(DataFrame.unionByName, done).dropDuplicates(ROW)


def exact_groups(docs: DataFrame, block_bytes: int = 2048, hash_bits: int = 64,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row key (``_ll_*``), id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and ``times`` (how often the very row occurs).

    Null text is empty; all empty texts are equal. Of equal texts the row with the largest id
    stays; a null id is smaller than any other. Rows equal in id and text are one document:
    they give one row, and count ``times`` towards ``group_size``. An empty table gives an
    empty result. Only the two named columns are read.
    """
    rows = keyed(docs, id_col, text_col).select(*ROW, F.unhex(F.sha2(text(text_col), 256)).alias("_ll_sha"))
    rows = rows.groupBy(*ROW, "_ll_sha").agg(F.count("*").alias("times"))
    named = materialize(same_row(rows, identities(docs, block_bytes, hash_bits, id_col, text_col)), "identities")
    who = ["_ll_level", "_ll_name"]
    groups = materialize(named.groupBy(*who).agg(
        F.max("_ll_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count("*").alias("_ll_rows")
    ), "groups")
    return _looked_up(named, groups, who, ROW).select(
        *ROW, F.col("_ll_id").alias(id_col), "keep_id", "group_size",
        F.col("_ll_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_ll_sha")).alias("text_sha256"), "times",
    )


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is in ``kept`` (key, ``times``), each once."""
    found = same_row(keyed(docs, id_col, text_col), kept.select(*ROW, F.col("times").alias("_ll_times")))
    if kept.where("times > 1").isEmpty():
        return found.select(*docs.columns)
    again = found.where("_ll_times > 1").dropDuplicates(ROW)
    return found.where("_ll_times = 1").unionByName(again).select(*docs.columns)
