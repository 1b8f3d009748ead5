"""Self-join of documents by the Jaccard similarity of their word n-grams.

MinHash banding: a signature has one band per tree, and documents of equal bands meet in a
node. The band's length is fixed before the data is seen, the longest with which the recall at
the threshold reaches the target (``prefix_depth``); nodes are not split by longer ones. What
meets is then verified on the n-grams of the whole texts.

Documents with the same set of n-grams are one class and travel once. A pair belongs to the
first tree in which it meets, so it is counted once without listing pairs: a task returns
per class the number of linked documents and the smallest class it is joined with. A crowded
node is dealt out as a grid of chunks, every pair of chunks a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.graph import components
from rotorwatch.llm.rows import ROW, keyed, same_row, text
from rotorwatch.llm.text import mix, owner, pieces, window_hashes, words
from rotorwatch.session import materialize

CLASS = ["_ll_s1", "_ll_s2"]
CELL = ["_ll_tree", "_ll_node", "_ll_i", "_ll_j"]


def prefix_depth(trees: int, most: int, threshold: float, recall: float) -> int:
    """Shorten the matched prefix until documents at the threshold meet in some tree with
    the wanted probability."""
    for depth in range(most, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingle_sets(data, bounds, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each document, and where each document's begin. Documents of
    fewer than n words have one, of all their words."""
    w = words(data, bounds)
    count = np.diff(w.first)
    if not len(w.hash):
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    grams = window_hashes(w.hash, n)
    doc = owner(w.first)
    inside = np.arange(len(grams)) + n <= w.first[1:][doc[:len(grams)]]
    grams, of = grams[inside], doc[:len(grams)][inside]
    few = np.flatnonzero((count > 0) & (count < n))
    short = np.array([window_hashes(w.hash[w.first[d]:w.first[d + 1]], int(count[d]))[0] for d in few], np.uint64)
    grams, of = np.concatenate([grams, short]), np.concatenate([of, few])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(count) + 1))


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:k] | np.uint64(1), seeds[k:]


def minhash(grams, first, k: int) -> np.ndarray:
    """Signatures, one row of k unsigned 32-bit integers per document; zeros without n-grams."""
    out = np.zeros((len(first) - 1, k), np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        base = (grams >> np.uint64(32)).astype(np.uint64)
        for p, (a, b) in enumerate(zip(*_permutations(k), strict=True)):
            v = ((grams ^ b) * a + base) >> np.uint64(32)
            out[some, p] = np.minimum.reduceat(v.astype(np.uint32), first[:-1][some])
    return out


def _signatures(docs, n, k):
    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in pieces(batch, "_ll_text"):
                grams, first = shingle_sets(data, bounds, n)
                sig = minhash(grams, first, k)
                keys = []
                for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
                    keys.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in ROW], *[pa.array(x) for x in keys],
                    pa.array(np.diff(first).astype(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary()),
                ], [*ROW, *CLASS, "_ll_grams", "_ll_sig"])

    kind = docs.schema["_ll_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_ll_id {kind}, _ll_hash long, _ll_size int, _ll_s1 long, _ll_s2 long, "
                                "_ll_grams long, _ll_sig binary")


def _once(table, starts):
    """Without rows of a class that a cell has already (from repeated rows of the input)."""
    again = np.ones(table.num_rows, bool)
    again[starts[:-1]] = False
    for c in CLASS:
        x = table.column(c).to_numpy()
        again[1:] &= x[1:] == x[:-1]
    if not again.any():
        return table, starts
    kept = np.concatenate([[0], np.cumsum(~again)])
    return table.filter(pa.array(~again)).combine_chunks(), kept[starts]


def _runs(batches):
    """Sorted batches again, cut where a cell ends: ``(table, starts)``; a cell is never split."""
    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in CELL]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if rest:
            new[0] = any(rest[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in CELL)
        starts = np.flatnonzero(new)
        if not len(starts):
            rest.append(batch)
            continue
        last = int(starts[-1])
        whole = pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
        if whole.num_rows:
            before = whole.num_rows - last
            inner = starts[:-1] + before
            yield _once(whole, np.unique(np.concatenate([[0], inner, [whole.num_rows]])).astype(np.int64))
        rest = [batch.slice(last)]
    if rest:
        whole = pa.Table.from_batches(rest).combine_chunks()
        cols = [whole.column(c).to_numpy() for c in CELL]
        new = np.zeros(whole.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        yield _once(whole, np.concatenate([[0], np.flatnonzero(new), [whole.num_rows]]).astype(np.int64))


def _candidates(sig, size, mine, tree, across, trees, depth, threshold):
    """Pairs of a cell that meet first in this tree, as (a, array of b). Left out is what
    can't reach the threshold by the numbers of n-grams, and what by its signature is unlikely to:
    five standard deviations fewer equal places than at the threshold, which drops about 4 pairs
    in a million at 0.8."""
    k = trees * depth
    least = k * threshold - 5 * np.sqrt(k * threshold * (1 - threshold))
    for a in range(len(sig)):
        if across:
            if mine[a]:
                continue
            b = np.flatnonzero(mine)
        else:
            b = np.arange(a + 1, len(sig))
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        b = b[small >= threshold * large]
        if not len(b):
            continue
        same = sig[b] == sig[a]
        b_ok = same.sum(1) >= least
        met = same.reshape(len(b), trees, depth).all(2)
        b = b[b_ok & met[:, tree] & ~met[:, :tree].any(1)]
        if len(b):
            yield a, b


def _cells(table, starts, trees, depth, threshold):
    get = {c: table.column(c).to_numpy() for c in (*CELL, "_ll_mine", "_ll_grams")}
    sigs = np.frombuffer(b"".join(table.column("_ll_sig").to_pylist()), np.uint32).reshape(table.num_rows, -1)
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        if hi - lo < 2:
            continue
        across = get["_ll_i"][lo] != get["_ll_j"][lo]
        mine = get["_ll_mine"][lo:hi] == get["_ll_j"][lo]
        found = list(_candidates(sigs[lo:hi], get["_ll_grams"][lo:hi], mine, int(get["_ll_tree"][lo]), across,
                                 trees, depth, threshold))
        if found:
            yield lo, hi, found


def _flag(trees, depth, threshold):
    """Keep the members of a cell that have a pair to verify there."""
    def run(batches):
        for table, starts in _runs(batches):
            keep = np.zeros(table.num_rows, bool)
            for lo, _, found in _cells(table, starts, trees, depth, threshold):
                for a, b in found:
                    keep[lo + a] = True
                    keep[lo + b] = True
            if keep.any():
                yield from table.filter(pa.array(keep)).combine_chunks().to_batches()
    return run


def _verify(n, trees, depth, threshold):
    def run(batches):
        for table, starts in _runs(batches):
            texts = table.column("_ll_text").combine_chunks()
            weight = table.column("_ll_members").to_numpy()
            s1, s2 = (table.column(c).to_numpy() for c in CLASS)
            out = []
            for lo, hi, found in _cells(table, starts, trees, depth, threshold):
                batch = pa.RecordBatch.from_arrays([texts.slice(lo, hi - lo)], ["t"])
                sets = []
                for _, _, data, bounds in pieces(batch, "t"):
                    grams, first = shingle_sets(data, bounds, n)
                    sets += np.split(grams, first[1:-1])
                _, code = np.unique(np.concatenate(sets), return_inverse=True)
                sets = np.split(code, np.cumsum([len(x) for x in sets])[:-1])
                mark = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
                links, label = np.zeros(hi - lo, np.int64), np.arange(hi - lo)

                def root(x, label=label):
                    while label[x] != x:
                        label[x] = label[label[x]]
                        x = label[x]
                    return x

                order = np.lexsort((s2[lo:hi], s1[lo:hi]))
                rank = np.empty_like(order)
                rank[order] = np.arange(hi - lo)
                for a, b in found:
                    mark[sets[a]] = 1
                    sizes = np.array([len(sets[x]) for x in b])
                    both = np.add.reduceat(mark[np.concatenate([sets[x] for x in b])],
                                           np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                    mark[sets[a]] = 0
                    b = b[both >= threshold * (len(sets[a]) + sizes - both) - 1e-9]
                    links[a] += weight[lo + b].sum()
                    links[b] += weight[lo + a]
                    for x in b:
                        p, q = root(a), root(x)
                        if p != q:
                            p, q = (p, q) if rank[p] < rank[q] else (q, p)
                            label[q] = p
                top = np.array([root(x) for x in range(hi - lo)])
                some = np.flatnonzero(links)
                out.append((s1[lo:hi][some], s2[lo:hi][some], links[some], s1[lo:hi][top[some]], s2[lo:hi][top[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                                 [*CLASS, "_ll_links", "_ll_t1", "_ll_t2"])
    return run


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, words_per_gram: int = 5, trees: int = 16, most_depth: int = 8,
    recall: float = 0.9995, chunk: int = 512, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: row key (``_ll_*``), id, ``class_id`` (smallest id that can be reached over
    links), ``n_links`` (other documents with a similarity of at least ``threshold``), ``first`` (true
    for one document of each class, that of the smallest id) and ``times`` (how often the very
    row occurs; such rows are one document, and count as others to each other).

    Null text is empty. Documents without words have no links and are classes of their own;
    those of fewer words than an n-gram are compared by all their words. Null ids come last.
    An empty table gives an empty result. Only the two named columns are read.
    """
    spark = docs.sparkSession
    depth = prefix_depth(trees, most_depth, threshold, recall)
    rows = keyed(docs, id_col, text_col).select(*ROW, text(text_col).alias("_ll_text"))
    sigs = materialize(_signatures(rows, words_per_gram, trees * depth), "signatures")
    who = F.struct(F.col("_ll_id").isNull().alias("no_id"), *ROW)
    classes = sigs.where("_ll_grams > 0").groupBy(*CLASS, "_ll_grams").agg(
        F.min(F.struct(who.alias("who"), F.col("_ll_sig"))).alias("m"), F.count("*").alias("_ll_members")
    ).select(*CLASS, "_ll_grams", "_ll_members", *[F.col(f"m.who.{c}").alias(c) for c in ROW], F.col("m._ll_sig").alias("_ll_sig"))
    classes = materialize(classes, "classes")
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.xxhash64(F.substring(F.col("_ll_sig"), t * 4 * depth + 1, F.lit(4 * depth))),
    )
    nodes = classes.select(*CLASS, F.posexplode(labels).alias("_ll_tree", "_ll_node"))
    busy = nodes.groupBy("_ll_tree", "_ll_node").count().where("count > 1").withColumn(
        "_ll_chunks", F.ceil(F.col("count") / chunk).cast("int")).drop("count")
    met = materialize(nodes.join(busy, ["_ll_tree", "_ll_node"]), "nodes")
    mine = F.pmod(F.xxhash64(*CLASS), F.col("_ll_chunks")).cast("int")
    cells = met.withColumn("_ll_mine", mine).withColumn(
        "_ll_other", F.explode(F.sequence(F.lit(0), F.col("_ll_chunks") - 1))
    ).select(
        *CLASS, "_ll_tree", "_ll_node", F.least("_ll_mine", "_ll_other").alias("_ll_i"),
        F.greatest("_ll_mine", "_ll_other").alias("_ll_j"), "_ll_mine",
    ).join(classes, CLASS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, *CELL).sortWithinPartitions(*CELL, *CLASS)
    flagged = materialize(dealt.mapInArrow(_flag(trees, depth, threshold), dealt.schema), "pairs")
    whole = same_row(flagged, rows)
    whole = whole.repartition(parts, *CELL).sortWithinPartitions(*CELL, *CLASS)
    schema = "_ll_s1 long, _ll_s2 long, _ll_links long, _ll_t1 long, _ll_t2 long"
    found = materialize(whole.mapInArrow(_verify(words_per_gram, trees, depth, threshold), schema), "links")
    links = found.groupBy(*CLASS).agg(F.sum("_ll_links").alias("_ll_links"))
    edges = found.select(F.struct(*CLASS).alias("a"), F.struct(F.col("_ll_t1").alias("_ll_s1"), F.col("_ll_t2").alias("_ll_s2")).alias("b"))
    joined = components(edges).select("node._ll_s1", "node._ll_s2", F.col("label").alias("_ll_label"))
    named = classes.select(*CLASS, "_ll_members", *[F.col(c).alias(f"{c}_c") for c in ROW]).join(links, CLASS, "left").join(joined, CLASS, "left")
    named = named.withColumn("_ll_label", F.coalesce("_ll_label", F.struct(*CLASS)))
    top = named.groupBy("_ll_label").agg(F.min(F.struct(
        F.col("_ll_id_c").isNull().alias("no_id"), *[F.col(f"{c}_c").alias(c) for c in ROW])).alias("_ll_top"))
    named = named.join(top, "_ll_label").select(*CLASS, "_ll_members", "_ll_links", "_ll_top")
    docs_ = sigs.groupBy(*ROW, *CLASS, "_ll_grams").agg(F.count("*").alias("times"))
    out = docs_.join(named, CLASS, "left").withColumn("_ll_has", F.col("_ll_grams") > 0)
    mine = F.struct(F.col("_ll_id").isNull().alias("no_id"), *ROW)
    return out.select(
        *ROW, F.col("_ll_id").alias(id_col),
        F.when(F.col("_ll_has"), F.col("_ll_top._ll_id")).otherwise(F.col("_ll_id")).alias("class_id"),
        F.when(F.col("_ll_has"), F.coalesce("_ll_links", F.lit(0)) + F.col("_ll_members") - 1).otherwise(F.lit(0)).alias("n_links"),
        F.when(F.col("_ll_has"), F.col("_ll_top") == mine).otherwise(F.lit(True)).alias("first"), "times",
    )
