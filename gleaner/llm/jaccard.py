"""N-gram Jaccard join by token-combination prefixes.

Texts become sets of word shingles; equal sets are one node. A sketch counts every shingle of every
document and marks frequent ones. A global order puts rare shingles first. A set's prefix is extended
until a partner above the threshold must share with it one rare shingle or two frequent ones of one
group: rare shingles are indexed alone, frequent ones in pairs within groups.

Why no link is lost: let x's prefix end no later in the order than y's, and let x miss at most
``n - ceil(t n)`` of its shingles in y. With r rare shingles and n_g frequent ones of group g in the
prefix, sharing no index entry means missing at least r + sum(n_g - 1) of them, and the prefix is taken
so long that this exceeds the allowed number. What x and y share up to the end of x's prefix lies in y's
prefix as well. Groups follow the power of two below the smaller set's size; a set is indexed for each
power that a partner no larger than itself may have.

Members of an index entry are compared by size and by 256-bit parity bitmaps, which bound the overlap
from above; pairs that pass are compared by longer bitmaps, and what is left is verified on the sets. In
a first round each set is verified against the one partner that most of its entries propose, which joins
most groups to their hubs. In the rounds that follow, members propose all candidates not linked to them
yet, until none is left: all candidates are settled, without all pairs of a large group. Entries with more than ``CHUNK`` members
are split into blocks that are compared by twos in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCKS, batch_of, block_batch, merged_blocks
from .common import bounded_batches, discard, saved, scratch, table
from .components import components
from .files import filesystem
from .shingles import differing_bits, mixed, parity_bitmap, set_key, shingle_sets, sized_bitmap

SKETCH = 1 << 20
#: A shingle is frequent if its counter exceeds the mean counter by this many.
FREQUENT = 64
#: Frequent shingles of a group, on average, in a set of the smallest size it is used for.
GROUP = 4
CHUNK = 1024
#: Candidates that a member of an entry proposes, up to this number, in the rounds after the first.
ROUNDS = (16, None)
FILTER_BITS = 1 << 23


def hashed(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: a document's id, hash of its row, set size and set key; or a block of the task's shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, none = np.zeros(SKETCH, np.int64), pa.nulls
        for batch in batches:
            size, keys = np.zeros(len(batch), np.int64), np.zeros((len(batch), 2), np.int64)
            for i, tokens in shingle_sets(batch.column(1), n):
                size[i], keys[i] = len(tokens), set_key(tokens)
                np.add.at(counts, (tokens & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            k = len(batch)
            yield batch_of({"doc_id": batch.column(0).cast(pa.int64()), "row": batch.column(2), "n": pa.array(size), "s1": pa.array(keys[:, 0]), "s2": pa.array(keys[:, 1]), "block": none(k, pa.int32()), "counts": none(k, pa.binary())})
        blocks = [x.astype("<u4").tobytes() for x in np.split(counts, BLOCKS)] if counts.any() else []
        k = len(blocks)
        yield batch_of({"doc_id": none(k, pa.int64()), "row": none(k, pa.int64()), "n": none(k, pa.int64()), "s1": none(k, pa.int64()), "s2": none(k, pa.int64()), "block": pa.array(range(k), pa.int32()), "counts": pa.array(blocks, pa.binary())})

    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", row.alias("row")).mapInArrow(run, "doc_id long, row long, n long, s1 long, s2 long, block int, counts binary")


def index_entries(tokens: np.ndarray, rare: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of one set, by the rule in the module's docstring."""
    n = len(tokens)
    least = -(-percent * n // 100)
    need = n - least + 1
    if need == 1 and n * 100 // percent == n:
        return tokens[:0]  # no other set can be near enough
    order = np.sort(mixed(tokens[rare]))
    if len(order) >= need:
        return order[:need]
    often = np.sort(mixed(tokens[~rare]))
    entries = [order]
    for power in range(int(least).bit_length() - 1, n.bit_length()):
        groups = max(1, (1 << power) // GROUP)
        group = (mixed(often) % np.uint64(groups)).astype(np.int64)
        # How many members of its group each frequent shingle follows: all but a group's first count.
        by_group = np.argsort(group, kind="stable")
        new = np.append(True, group[by_group][1:] != group[by_group][:-1])
        counted = np.zeros(len(often), np.int64)
        counted[by_group] = ~new
        until = int(np.searchsorted(np.cumsum(counted), need - len(order))) + 1
        own, in_group = often[:until], group[:until]
        by_group = np.argsort(in_group, kind="stable")
        own, in_group = own[by_group], in_group[by_group]
        for shift in range(1, len(own)):
            same = in_group[shift:] == in_group[:-shift]
            if not same.any():
                break
            entries.append(mixed(own[:-shift][same] * np.uint64(0x9E3779B97F4A7C15) + own[shift:][same] + np.uint64(power)))
    return np.unique(np.concatenate(entries))


def nodes(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Saved tables of a row a distinct set: its key, size and bitmaps; and its key and index entries."""
    frequent = docs.sparkSession.sparkContext.broadcast(np.packbits(sketch > sketch.mean() + FREQUENT))
    schema = "s1 long, s2 long, n long, b0 long, b1 long, b2 long, b3 long, entries array<long>, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(frequent.value).astype(bool)
        for batch in batches:
            rows, entries, bits = [], [], []
            for _, tokens in shingle_sets(batch.column(0), n):
                if len(tokens):
                    found = index_entries(tokens, ~often[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)], percent)
                    if len(found):
                        rows.append((*set_key(tokens), len(tokens), *parity_bitmap(tokens).tolist()))
                        entries.append(found.view(np.int64))
                        bits.append(sized_bitmap(tokens))
            if rows:
                ends = np.cumsum([0, *map(len, entries)]).astype(np.int32)
                table = np.array(rows, np.int64)
                names = ["s1", "s2", "n", "b0", "b1", "b2", "b3"]
                yield batch_of({k: pa.array(table[:, i]) for i, k in enumerate(names)} | {"entries": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(entries))), "bits": pa.array(bits, pa.binary())})

    rows = docs.select("text").mapInArrow(run, schema)
    once = rows.groupBy("s1", "s2").agg(*(F.first(c).alias(c) for c in rows.columns[2:]))
    # A node's index entries are of use until those that others share are known: they are a part of their own.
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    own = [c for c in rows.columns[2:] if c != "entries"]
    parts = F.array(F.struct(F.lit("entries").alias("part"), *map(none, own), F.col("entries")), F.struct(F.lit("node").alias("part"), *own, none("entries")))
    path = scratch(docs.sparkSession, "nodes")
    once.select("s1", "s2", F.explode(parts).alias("x")).select("s1", "s2", "x.*").write.partitionBy("part").option("compression", "zstd").parquet(path)
    store, folder = filesystem(path)
    for part in ("node", "entries"):  # where no set can be near another there are none
        store.create_dir(f"{folder}/part={part}", recursive=True)
    read = lambda part, columns: docs.sparkSession.read.schema(rows.select(*columns).schema).parquet(f"{path}/part={part}")
    node, entries = read("node", ["s1", "s2", *own]), read("entries", ["s1", "s2", "entries"])
    node.saved_at, entries.saved_at = f"{path}/part=node", f"{path}/part=entries"
    return node, entries


def close(n1: np.ndarray, n2: np.ndarray, b1: np.ndarray, b2: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets may reach the threshold, by size and bitmap (the last axis holds the words)."""
    differ = np.bitwise_count(b1 ^ b2).sum(-1, dtype=np.int64)
    most = np.minimum((n1 + n2 - differ) // 2, np.minimum(n1, n2))
    return 100 * most >= percent * (n1 + n2 - most)


def partners(keys: np.ndarray, block: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same entry that may be near; of an entry of two blocks, one row of each."""
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    length = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    for s in range(1, int(min(length.max(initial=0), 33))):
        rows = np.concatenate([np.arange(a, a + m - s) for a, m in zip(starts[length > s], length[length > s], strict=True) if m <= 33] or [np.zeros(0, np.int64)]) if s > 1 else np.flatnonzero((keys[1:] == keys[:-1]).all(1) & np.repeat(length <= 33, length)[:-1])
        ok = close(size[rows], size[rows + s], bits[rows], bits[rows + s], percent)
        left.append(rows[ok])
        right.append(rows[ok] + s)
    for a, m in zip(starts[length > 33], length[length > 33], strict=True):
        for lo in range(a, a + m, 128):
            hi = min(lo + 128, a + m)
            i, j = np.arange(lo, hi), np.arange(a, hi)
            ok = close(size[i, None], size[None, a:hi], bits[i, None], bits[None, a:hi], percent) & (j[None] < i[:, None])
            x, y = np.nonzero(ok)
            left.append(j[y])
            right.append(i[x])
    left, right = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)
    two = keys[left, 1] != keys[left, 2]
    keep = ~two | (block[left] != block[right])
    return left[keep], right[keep]


ENTRY = "entry long, c1 long, c2 long, c long, n long, s1 long, s2 long, b0 long, b1 long, b2 long, b3 long, root long"
PAIRS = "a1 long, a2 long, b1 long, b2 long, entry long, kind int"
PAIR, OPEN, NODE = range(3)


def proposed(entries: DataFrame, percent: int, skip: int, most: int | None) -> DataFrame:
    """Pairs that members propose: each with its candidates number ``skip`` up to ``most``, not linked yet.

    Of kind ``OPEN`` are entries in which some member has further candidates, of kind ``NODE`` members
    that have candidates but are in no pair here.
    """

    def settle(t: np.ndarray) -> pa.RecordBatch:
        left, right = partners(t[:, :3], t[:, 3], t[:, 4], t[:, 7:11].view(np.uint64), percent)
        order = np.lexsort((left, right))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.append(True, right[1:] != right[:-1])) if len(right) else np.zeros(0, np.int64)
        rank = np.arange(len(right)) - np.repeat(first, np.diff(np.append(first, len(right))))
        apart = t[left, 11] != t[right, 11]
        now = (rank >= skip) & apart & (rank < most if most else True)
        late = np.unique(t[left[(rank >= most) & apart], 0]) if most else t[:0, 0]
        rest = np.setdiff1d(left[apart], np.append(left[now], right[now]))
        a, b = np.concatenate([t[left[now]], t[rest]]), t[right[now]]
        n, m, k = len(b), len(rest), len(late)
        columns = {"a1": a[:, 5], "a2": a[:, 6], "b1": b[:, 5], "b2": b[:, 6], "entry": np.concatenate([b[:, 0], t[rest, 0], late])}
        full = {c: pa.concat_arrays([pa.array(v), pa.nulls(n + m + k - len(v), pa.int64())]) for c, v in columns.items()}
        return batch_of(full | {"kind": pa.array(np.repeat([PAIR, NODE, OPEN], [n, m, k]).astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            t = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns], 1)
            if not len(t):
                continue
            last = (t[:, :3] == t[-1, :3]).all(1)
            whole = np.concatenate([*held, t[~last]]) if not last.all() or held and (held[-1][-1, :3] != t[-1, :3]).any() else None
            if whole is not None:
                yield settle(whole)
                held = []
            held.append(t[last])
        if held:
            yield settle(np.concatenate(held))

    key = ("entry", "c1", "c2")
    return entries.repartition(*key).sortWithinPartitions(*key, "n", "s1", "s2").mapInArrow(run, PAIRS)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds the low bits of every key (one long column of hashes).

    It only thins out rows before a shuffle; the join that follows is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().astype(np.int64) & (FILTER_BITS - 1)] = True
        if bits.any():
            yield block_batch(np.packbits(bits), "u1")

    return merged_blocks(keys.mapInArrow(run, "block int, counts binary"), np.bitwise_or, "u1")


def shared_members(node: DataFrame, shared: DataFrame) -> DataFrame:
    """Entries of all nodes that are in ``shared`` (entry, members), a row each."""
    bits = node.sparkSession.sparkContext.broadcast(bit_filter(shared.select("entry")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            lists = batch.column(2)
            entry = lists.flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            keep = table[entry & (FILTER_BITS - 1)] if len(table) else np.zeros(0, bool)
            at = pa.array(of[keep])
            yield batch_of({"s1": batch.column(0).take(at), "s2": batch.column(1).take(at), "entry": pa.array(entry[keep])})

    found = node.select("s1", "s2", "entries").mapInArrow(run, "s1 long, s2 long, entry long")
    return found.join(shared, "entry")


def texts_of(docs: DataFrame, n: int, needed: DataFrame) -> DataFrame:
    """Texts of the nodes in ``needed`` (s1, s2, name), each from rows of the document that names it.

    Texts are shorter than their sets of hashes and pack well; a few rows that are not needed may come along.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(needed.select("s1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            where, rows = [], []
            for i, tokens in shingle_sets(batch.column(1), n):
                if len(tokens) and len(table) and table[(key := set_key(tokens))[0] & (FILTER_BITS - 1)]:
                    where.append(i)
                    rows.append(key)
            keys, at = np.array(rows, np.int64).reshape(-1, 2), pa.array(where, pa.int64())
            yield batch_of({"s1": pa.array(keys[:, 0]), "s2": pa.array(keys[:, 1]), "doc_id": batch.column(0).cast(pa.int64()).take(at), "t": batch.column(1).cast(pa.string()).take(at)})

    found = docs.select("doc_id", "text").mapInArrow(run, "s1 long, s2 long, doc_id long, t string")
    # Copies would meet again and again in the joins: one text a node is kept. The id is a key of the join, so copies are
    # dealt to many tasks; duplicates are dropped by the same keys, so texts are shuffled once.
    key = ["s1", "s2", "id", "nameless"]
    keyed = lambda rows, c, *more: rows.select("s1", "s2", F.coalesce(c, F.lit(0)).alias("id"), F.col(c).isNull().alias("nameless"), *more)
    return keyed(found, "doc_id", "t").join(keyed(needed, "name"), key).dropDuplicates(key).select("s1", "s2", "t")


def likely(pairs: DataFrame, node: DataFrame, percent: int) -> DataFrame:
    """The pairs that may reach the threshold by their longer bitmaps."""
    a, b = node.select("s1", "s2", "n", "bits").toDF("a1", "a2", "na", "xa"), node.select("s1", "s2", "n", "bits").toDF("b1", "b2", "nb", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
                most = min((n + m - differing_bits(x, y)) // 2, n, m)
                keep.append(100 * most >= percent * (n + m - most))
            yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "na", "nb", "xa", "xb")
    return joined.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def thinned(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose first column, a hash, is not in ``keys`` (one column), before they are shuffled."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64)
            yield batch.filter(pa.array(table[key & (FILTER_BITS - 1)] if len(table) else np.zeros(len(key), bool)))

    return rows.mapInArrow(run, rows.schema)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a saved table) whose sets reach the threshold; of the texts, only those of pairs are moved."""
    a, b = (thinned(texts, pairs.select(f"{x}1")).toDF(f"{x}1", f"{x}2", f"t{x}") for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            keys = zip(batch.column("a1").to_pylist(), batch.column("a2").to_pylist(), strict=True)
            for i, (key, (_, y)) in enumerate(zip(keys, shingle_sets(batch.column("tb"), n), strict=True)):
                if key != held:  # rows come sorted by the first of the pair: a hub is hashed once
                    held, x = key, next(shingle_sets(batch.column("ta")[i : i + 1], n))[1]
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                both = int((many[at] == few).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(b, ["b1", "b2"]).join(a, ["a1", "a2"]).select("a1", "a2", "b1", "b2", "ta", "tb")
    return joined.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``jaccard_components`` with the row's ``row`` (if ``docs`` has one) and ``part``, a number that each component has of its own."""
    both = saved(hashed(bounded_batches(docs), n), "hashed")
    own = both.where("block is null").select("doc_id", "row", "n", "s1", "s2")
    sketch = merged_blocks(both.where("block is not null"), np.add, "<u4")
    # A class of equal sets is known by a number of its own, ``rep``; its smallest doc_id is its ``name``.
    named = own.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("name"))
    classes = saved(named.withColumn("rep", F.monotonically_increasing_id()), "classes")
    label = classes.select("s1", "s2", F.col("name").alias("label"), F.col("rep").alias("part"))
    if len(sketch):
        roots = all_links(docs, n, percent, sketch, classes, same_documents(own, classes))
        found = roots.join(classes.select(F.col("rep").alias("v"), "name"), "v")
        tops = found.join(found.groupBy("root").agg(F.min("name").alias("top")), "root").select(F.col("v").alias("rep"), "top", "root")
        label = classes.join(tops, "rep", "left").select("s1", "s2", F.coalesce("top", "name").alias("label"), F.coalesce("root", "rep").alias("part"))
    rows = own.join(label, ["s1", "s2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"), "row", F.when(F.col("n") > 0, F.col("part")).alias("part"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets; component_id is
    the smallest doc_id that links reach. Null and empty texts have size 0 and their own doc_id; rows
    with equal doc_id count as one document for links; a row without a doc_id links like any other, but
    names no component (one of such rows alone has a null name); texts of any length are read whole; an empty
    table gives no rows; further columns of ``docs`` are not read.
    """
    return groups(docs.select("doc_id", "text"), n, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text and any more columns), and all rows without words.

    The row of smallest doc_id stays, one without a doc_id only where all are; of several such rows (a doc_id repeated, or
    none) one of them stays, the same on every run, and of rows alike in all columns one. A component is known by a number
    of its own, so it does not matter whether its rows have doc_ids, or whether others lack them.
    """
    columns = docs.columns
    # Two rows of a component and doc_id that differ have different hashes but for one chance in 2^64.
    rows = docs.withColumn("row", F.xxhash64(*columns))
    found = groups(rows.select("doc_id", "text", "row"), n, percent).where("part is not null").groupBy("part", "doc_id", "row").agg(F.count("*").alias("copies"))
    first = F.min_by(F.struct("doc_id", "row", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    chosen = saved(found.groupBy("part").agg(first.alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.row").alias("_row"), (F.col("x.copies") > 1).alias("_copied")), "chosen")
    kept = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    copied = kept.where("_copied").select(*columns).dropDuplicates()
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.where("not _copied").select(*columns).union(copied).union(wordless)


def same_documents(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between classes that rows of one doc_id are in."""
    sets = own.where("n > 0 and doc_id is not null")
    span = sets.groupBy("doc_id").agg(*(f(c).alias(f"{c}_{name}") for c in ("s1", "s2") for name, f in (("a", F.min), ("z", F.max))))
    repeated = saved(span.where("s1_a <> s1_z or s2_a <> s2_z").select("doc_id"), "repeated-documents")
    if not repeated.take(1):
        return repeated.select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))
    several = sets.select("doc_id", "s1", "s2").join(repeated, "doc_id").distinct()
    least = several.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("a"))
    # Every class of such a doc_id is linked to the smallest of them.
    pairs = several.join(least, "doc_id").where(F.struct("s1", "s2") != F.col("a")).select(F.col("a.s1").alias("a1"), F.col("a.s2").alias("a2"), F.col("s1").alias("b1"), F.col("s2").alias("b2")).distinct()
    return saved(class_pairs(pairs, classes), "same-documents")


def class_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of set keys as pairs (u, v) of class numbers."""
    number = classes.select("s1", "s2", "rep")
    return pairs.join(number.toDF("a1", "a2", "u"), ["a1", "a2"]).join(number.toDF("b1", "b2", "v"), ["b1", "b2"]).select("u", "v")


def all_links(docs: DataFrame, n: int, percent: int, sketch: np.ndarray, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Components (v, root) over the classes' ``rep``, of ``links`` known before and all others."""
    node, entries = nodes(docs, n, percent, sketch)
    single = entries.select(F.explode("entries").alias("entry"))
    shared = saved(single.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    member = saved(shared_members(entries, shared), "members")
    discard(entries, shared)
    sized = node.drop("bits").join(classes.select("s1", "s2", "rep"), ["s1", "s2"])
    split = F.ceil(F.col("members") / CHUNK).cast("long")
    chunk = F.pmod(F.col("s1"), split)
    columns = [x.split()[0] for x in ENTRY.split(", ")]

    def placed(member: DataFrame) -> DataFrame:
        rows = member.join(sized, ["s1", "s2"]).withColumn("c", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), split - 1)))
        return rows.select("entry", F.least("c", "other").alias("c1"), F.greatest("c", "other").alias("c2"), "c", "n", "s1", "s2", "b0", "b1", "b2", "b3", "rep")

    def settled(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links found so far and their components, after verification of ``pairs``."""
        near = saved(likely(pairs, node, percent), "likely")
        links = links.union(saved(class_pairs(verified(near, texts, n, percent), classes), "links"))
        discard(near)
        return links, saved(components(links), "roots")

    # First round: of the first candidates in all its entries, each set's most frequent one.
    found = saved(proposed(placed(member).withColumn("root", F.xxhash64("s1", "s2")).select(*columns), percent, 0, 1), "proposed")
    pairs = found.where(F.col("kind") == PAIR)
    needed = found.where(F.col("kind") != OPEN).select(F.col("a1").alias("s1"), F.col("a2").alias("s2")).union(pairs.select("b1", "b2")).distinct()
    needed = saved(needed.join(classes.select("s1", "s2", "name"), ["s1", "s2"]), "needed")
    texts = saved(texts_of(docs, n, needed), "texts")
    discard(needed)
    votes = pairs.groupBy("b1", "b2", "a1", "a2").agg(F.count("*").alias("votes"))
    choice = votes.groupBy("b1", "b2").agg(F.max_by(F.struct("a1", "a2"), F.struct("votes", "a1", "a2")).alias("a"))
    links, roots = settled(choice.select("a.a1", "a.a2", "b1", "b2"), links)
    skip = 0
    for most in ROUNDS:
        # In the rounds after the first, entries with a member that has further candidates.
        still = F.col("kind") == OPEN if skip else F.col("kind") != NODE
        open_entries = found.where(still).select("entry").distinct()
        rows = placed(member.join(open_entries, "entry", "left_semi")).join(roots.withColumnRenamed("v", "rep"), "rep", "left")
        rows = rows.withColumn("root", F.coalesce("root", "rep")).select(*columns)
        before, found = found, saved(proposed(rows, percent, skip, most), "proposed")
        discard(before)
        links, roots = settled(found.where(F.col("kind") == PAIR).select("a1", "a2", "b1", "b2").distinct(), links)
        if not most or not found.where(F.col("kind") == OPEN).take(1):
            break
        skip = most
    discard(found, member, texts, node)
    return roots


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)
