r"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles (A-Z in lower case, words split at space and
\t \n \v \f \r); with one to four words the whole sequence is the only element.  Equal word sequences
form one class, and everything below works on classes.

1. Sketch: the SKETCH smallest 64-bit hashes of the set.
2. Inverted lists of retained values.  Two sets of similarity 0.75 share at least ``_overlap`` retained
   values, so in an order common to all sketches (rare values first) they share one among the first
   ``len - overlap + 1`` of each.  Only that part of a sketch is listed, and a value that one sketch
   alone retains is never listed.  A passage that many documents share is a frequent value, so it is listed
   only for documents that hold little else.
3. Every list draws one member as its leader, by a hash of value and member; pairs are (leader, member), so
   their number is that of the list entries.  Each class is held against the leader it shares most lists with.
4. Lists whose members then still lie in different components are compared in full.  Short ones give their pairs.
   Long ones are dealt out in blocks of members, and every two blocks meet in one task, which counts all
   intersections by matrix products and sends back no more edges than it needs to join its members.  Long lists
   that share members are dealt out once, as their union, where that makes fewer comparisons than list by list.
5. Before the sets of a pair are compared, sizes and the union-sketch estimate of the similarity filter; every
   link is confirmed on the full sets, as integers.

Two constants are statistical: a pair of similarity 0.75 or more with fewer than OVERLAP shared values or
an estimate below ESTIMATE is more than five standard deviations off (below one in ten million).  Sets
with up to three quarters of SKETCH elements are treated exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hourgrid.llm import textscan as S
from hourgrid.llm.components import components
from hourgrid.llm.scratch import Scratch

SHINGLE = 5
PERCENT = 75
SKETCH = 64
OVERLAP = 29
ESTIMATE = 0.45
#: Lists up to this length give pairs; longer ones are compared in blocks.
SMALL_LIST = 8
#: Members of a block; two blocks meet in one task.
BLOCK = 256
#: Elements whose membership is held as a matrix at once.
COLUMNS = 4096
#: Ids are sent to every executor below this count (8 bytes each), and joined by shuffle above it.
BROADCAST_IDS = 500_000


def shingle_sets(scan: S.Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every row, and the sets of all rows: sorted signed hashes, with the offsets of the rows."""
    scan = S.lowered(scan)
    start, end, row = scan.words()
    digest = scan.hash_of(start, end)
    count = S.per_row(row, scan.rows)
    first = np.concatenate([[0], np.cumsum(count)])
    whole = S.sequence_hash(digest, first)
    shingle, at = S.windows(digest, row, SHINGLE)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    item = np.concatenate([shingle, S.mix(whole[short] ^ np.uint64(0x5851F42D4C957F2D))]).view(np.int64)
    owner = np.concatenate([row[at], short])
    order = np.lexsort((item, owner))
    item, owner = item[order], owner[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
    item, owner = item[new], owner[new]
    return whole.view(np.int64), item, np.searchsorted(owner, np.arange(scan.rows + 1))


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids = part.column("doc_id")
        for first, scan in S.slices(part.column("__text")):
            node, item, at = shingle_sets(scan)
            size = np.diff(at)
            rank = np.arange(len(item)) - np.repeat(at[:-1], size)
            held = np.minimum(size, SKETCH)
            sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(item[rank < SKETCH]))
            yield pa.RecordBatch.from_arrays([ids.slice(first, scan.rows), pa.array(node), pa.array(size), sketch], ["doc_id", "node", "n_shingles", "sketch"])


def _full_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for _, scan in S.slices(part.column("__text")):
            node, item, at = shingle_sets(scan)
            data, edge = item.tobytes(), 8 * at
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array([data[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["node", "items"])


def _overlap(n: str = "n_shingles"):
    """Retained values that a partner shares at least, by the size of the set."""
    exact = F.ceil(F.col(n) * PERCENT / 100)
    return F.when(F.col(n) <= SKETCH * PERCENT // 100, exact).otherwise(F.lit(OVERLAP)).cast("int")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Are two sets, given as sorted distinct arrays, linked?  Size, then union sketch, then the full sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)) or not len(a):
        return False
    if max(len(a), len(b)) > SKETCH:
        union = np.union1d(a[:SKETCH], b[:SKETCH])[:SKETCH]
        shared = np.intersect1d(a[:SKETCH], b[:SKETCH], assume_unique=True)
        if np.isin(union, shared, assume_unique=True).sum() < ESTIMATE * len(union):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        left, right = part.column("left_items"), part.column("right_items")
        held = [similar(np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)) for a, b in zip(left, right)]
        yield part.select(["a", "b"]).filter(pa.array(held, pa.bool_()))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of the membership matrix of elements found twice or more."""
    item = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(item, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    live = times[column] > 1
    column, owner = place[column[live]], owner[live]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[part], column[part] - a] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _join_blocks(group: pa.Table) -> pa.Table:
    """Edges that join the members of one or two blocks as far as their sets allow."""
    sets = [np.frombuffer(b, np.int64) for b in group.column("items").to_pylist()]
    node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
    root = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
    size, both = np.array([len(s) for s in sets]), _shared(sets)
    linked = 100 * both >= PERCENT * (size[:, None] + size - both)
    if group.column("x")[0] != group.column("y")[0]:
        linked &= block[:, None] != block
    edges = []
    for i in range(len(sets)):
        while len(new := np.flatnonzero(linked[i] & (root != root[i]))):
            edges.append((node[i], node[new[0]]))
            root[root == root[new[0]]] = root[i]
    found = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (columns doc_id and text; others
    are not read).

    A null, empty or blank text has an empty set and is linked with nothing.  Repeated rows are rows of one
    class: each gets the same component, and each is kept if its doc_id is the component's.  A row without
    doc_id gets no component, joins no other rows by its id and is kept.  An empty table gives an empty result.
    """
    return marked(docs).drop("node", "comp")


def with_class(docs: DataFrame, name: str = "__node") -> DataFrame:
    """``docs`` with the hash of every row's word sequence, as ``marked`` has it, in a last column."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, scan in S.slices(part.column("text")):
                yield pa.RecordBatch.from_arrays([*part.slice(first, scan.rows).columns, pa.array(shingle_sets(scan)[0])], [*part.schema.names, name])

    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField(name, LongType())]))


def marked(docs: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` with node, the hash of the row's word sequence, and comp, which is the same for
    all rows of a component and no others but those of empty sets."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    texts = docs.select("doc_id", F.col("text").alias("__text"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.save(texts.mapInArrow(_sketches, f"doc_id {doc_type}, node long, n_shingles long, sketch array<long>"), "rows")

    classes = scratch.save(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    retained = classes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    common = retained.groupBy("value").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    listed = retained.join(common, "value").groupBy("node", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n_docs", "value"))).alias("held"))
    length = F.size("held") - _overlap() + 1
    index = scratch.save(listed.where(length > 0).select("node", F.explode(F.slice("held", F.lit(1), length)).alias("e")).select("e.value", "node"), "index")

    lists = index.groupBy("value").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("value", "node")).alias("a")).where("n > 1")
    pairs = index.join(lists, "value").where("node <> a").groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("shared"))
    pairs = scratch.save(pairs, "pairs")

    nodes = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    nodes = scratch.save(nodes, "nodes")
    ids = classes.join(nodes, "node", "left_semi").select("doc_id").distinct()
    few = nodes.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_full_sets, "node long, items binary")
    sets = scratch.save(wanted.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "sets")

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("left_items"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("right_items"))
        return scratch.save(some.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_confirm, "a long, b long"), name)

    def labelled(df: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
        return df.join(found.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    edges = confirmed(best, "edges-a")
    entries = labelled(index.join(lists.select("value", "n"), "value"), "node", components(scratch, edges, "parts-a"), "comp")
    mixed = entries.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("first")).where("lo <> hi")
    entries = scratch.save(entries.join(mixed.select("value", "first"), "value"), "mixed")

    few_each = entries.where(F.col("n") <= SMALL_LIST)
    other = few_each.select("value", F.col("node").alias("b"), F.col("comp").alias("other"))
    small = few_each.withColumnRenamed("node", "a").join(other, "value").where("a < b AND comp <> other").select("a", "b").distinct()
    edges = edges.unionByName(confirmed(small, "edges-b"))

    large = entries.where(F.col("n") > SMALL_LIST)
    joined = large.join(components(scratch, large.where("node <> first").select("node", "first"), "groups"), "node", "left")
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    cost = joined.groupBy("root").agg(F.count_distinct("node").alias("members"), F.sum("n").alias("by_list"))
    joined = joined.join(cost, "root").withColumn("whole", F.col("members") * F.col("members") <= F.col("by_list"))
    key = F.when(F.col("whole"), F.col("root")).otherwise(F.col("value"))
    members = F.when(F.col("whole"), F.col("members")).otherwise(F.col("n"))
    dealt = joined.select("whole", key.alias("key"), "node", "comp", F.ceil(members / BLOCK).cast("int").alias("blocks")).distinct()
    dealt = (dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")))
    rest = dealt.join(sets, "node").groupBy("whole", "key", "x", "y").applyInArrow(_join_blocks, "a long, b long")
    edges = edges.unionByName(scratch.save(rest, "edges-c"))
    found = components(scratch, edges, "parts")

    linked = labelled(classes.select("node", "doc_id", "members"), "node", found, "comp")
    smallest = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.sum("members").alias("n")).where("n > 1")
    label = scratch.save(linked.join(smallest, "comp").select("node", "component_id", "comp"), "labels")
    scratch.drop("classes", "index", "pairs", "nodes", "sets", "mixed", "edges-a", "edges-b", "edges-c")
    out = rows.select("doc_id", "node", "n_shingles").join(label, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "node", F.coalesce("comp", "node").alias("comp"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
