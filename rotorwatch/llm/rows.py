"""Column helpers the operators share. Internal columns begin with ``_ll_``."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ["_ll_id", "_ll_hash", "_ll_size"]


def text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(n: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add what tells rows apart: the id, and a hash and the length of the text for rows that
    share an id. Rows equal in all three are the same document given more than once."""
    return docs.withColumns({
        "_ll_id": F.col(id_col), "_ll_hash": F.xxhash64(text(text_col)),
        "_ll_size": F.octet_length(text(text_col)),
    })


def same_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the row's key, null ids equal; the right side's key is dropped."""
    right = right.withColumnsRenamed({c: f"{c}_r" for c in ROW})
    on = [left[c].eqNullSafe(right[f"{c}_r"]) for c in ROW]
    return left.join(right, on, how).drop(*[f"{c}_r" for c in ROW])


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; ``TOKENIZER_DIR`` names another folder."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
