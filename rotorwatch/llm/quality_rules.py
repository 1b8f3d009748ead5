"""Line-first cleaning, in column expressions alone.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go, and
a document that loses too much of its text goes as a whole. All of it stays within the row:
no shuffle, so neither a frequent line nor a large source gathers anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text

# What makes a line fail.
NAVIGATION = r"(?:\||»|›|>>|::|•)"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies"
    r"|copyright ©|©|subscribe to our newsletter|click here|enable javascript|log ?in to (?:your account|continue)"
    r"|lorem ipsum)"
)
WORD = r"[^ \t-\r]"


def _words(s: Column) -> Column:
    trimmed = F.trim(s, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def line_fails(line: Column, symbols: float = 0.1, links: int = 3, shout: int = 3) -> Column:
    """True for a line with words that breaks a rule: too many symbols for its length or too
    many exclamation marks (punctuation), several separators (navigation), or a stock phrase
    (boilerplate)."""
    size = F.length(line)
    return (
        (F.regexp_count(line, F.lit(r"[#*$%&|<>{}~^]")) > symbols * size)
        | (F.regexp_count(line, F.lit(r"!!")) >= shout)
        | (F.regexp_count(line, F.lit(NAVIGATION)) >= links)
        | line.rlike(BOILERPLATE)
    )


def clean(
    docs: DataFrame, least_words: int = 20, repeat_window: int = 8, repeat_percent: int = 30,
    lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``kept_share`` and ``cleaned``, the lines that
    passed.

    ``kept`` is false if ``base_failed``, or if failing lines held more than ``lost`` of the
    document's characters. Null text is empty: it has no words and fails. Rows are judged one
    by one, so repeated rows and null ids need no care, and an empty table gives an empty
    result. Windows of words are told apart by a 64-bit hash within their document.
    """
    w = repeat_window
    base = docs.select(F.col(id_col), text(text_col).alias("_ll_text"))
    split = base.select(
        id_col, "_ll_text", _words(F.col("_ll_text")).alias("_ll_words"),
        F.filter(F.split("_ll_text", "\n"), lambda x: x.rlike(WORD)).alias("_ll_lines"),
    )
    n = F.size("_ll_words")
    windows = F.when(n >= w, F.transform(
        F.sequence(F.lit(1), n - (w - 1)), lambda i: F.xxhash64(F.slice("_ll_words", i, w))
    )).otherwise(F.array().cast("array<bigint>"))
    judged = split.withColumn("_ll_windows", windows).withColumn(
        "_ll_good", F.filter("_ll_lines", lambda x: ~line_fails(x))
    )
    has_repeat = F.size("_ll_windows") > F.size(F.array_distinct("_ll_windows"))
    # Sorted by hash, windows of equal words are neighbours; their starts, in order, tell
    # how many words they cover: each as many as lie before the next start, at most w.
    by_hash = F.array_sort(F.transform("_ll_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.transform(F.array(by_hash), lambda s: F.array_sort(F.filter(
        F.transform(s, lambda x, k: F.when(
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
        )), lambda i: i.isNotNull(),
    )))[0]
    covered = F.aggregate(
        starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-w).alias("to")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(w), i - a["to"])).alias("n"), i.alias("to")),
        lambda a: a["n"],
    )
    # "to" is the last start; the first start adds w, later ones the words not yet covered.
    good, all_ = (F.length(F.array_join(c, "")) for c in ("_ll_good", "_ll_lines"))
    share = F.when(all_ > 0, good / all_).otherwise(F.lit(0.0))
    out = judged.select(
        id_col, n.cast("long").alias("n_words"),
        F.length(F.array_join("_ll_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_ll_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_ll_lines") - F.size(F.array_distinct("_ll_lines"))).cast("long").alias("n_dup_lines"),
        F.when(has_repeat, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        share.alias("kept_share"), F.array_join("_ll_good", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("kept_share") >= 1 - lost)
    )
