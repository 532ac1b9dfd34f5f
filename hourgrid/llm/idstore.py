"""Token ids of documents in binary shard files, with a minimal perfect hash index from document key to place.

Layout of a store (a folder):

``shard-<n>.ids``
    The ids of the shard's documents one after the other from byte 0 on, as unsigned integers of ``width`` bytes, every
    document closed by the end id; then the start of every document and the end of the last (in ids, 8 bytes each);
    then TRAILER: magic, documents, ids.
``index-<n>.mph``
    The keys whose hash falls into bucket n: HEADER (magic, keys, salt, levels), the levels' sizes, their bits, and one
    SLOT per key at the place that the perfect hash gives it: fingerprint, shard, place in the shard, ids.
``store.json``
    Width, number of buckets and end id.

Access by key reads one bucket's bits (bounded, see BUCKET_KEYS), one slot and the document's ids, whatever the size of
the store.  Documents lie in ascending order of their key, nulls first; equal keys lie side by side, and where they
cross shards the index holds a slot for each shard (``part`` 0, 1, ...).  All integers are little-endian.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hourgrid.llm import chunkcodes as C, textscan as S
from hourgrid.llm.files import NewFile, Pages, open_folder
from hourgrid.llm.perfecthash import PerfectHash
from hourgrid.llm.scratch import Scratch, bound_batches
from hourgrid.session import shared_dir

END_ID = 0
#: Text bytes of a shard, a row counting ROW_BYTES more, and keys of an index bucket, on average.
SHARD_BYTES = 64 << 20
ROW_BYTES = 64
BUCKET_KEYS = 65_536
#: Text bytes encoded at once.
TEXT_BYTES = 4 << 20
#: Bytes read from a shard at once, and the gap that is read over.
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10

TRAILER = struct.Struct("<8sQQ")
HEADER = struct.Struct("<8sQQQ")
SHARD_MAGIC, INDEX_MAGIC = b"IDSHARD1", b"IDINDEX1"
SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<u4"), ("parts", "<u4"), ("ordinal", "<u8"), ("offset", "<u8"), ("length", "<u8"), ("copies", "<u8")])
#: A column of the shuffle and the index: one row for the documents of one key in one shard.
ENTRY = "h1 long, h2 long, shard int, ordinal long, offset long, length long, copies long, ids long"


@dataclass(frozen=True)
class Store:
    root: str
    width: int
    buckets: int
    end_id: int


def _hashes(key: str = "doc_id") -> list:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1).cast("long"), key).alias("h2")]


def key_hashes(key: int | None) -> tuple[int, int]:
    """What Spark's xxhash64 makes of a long key alone and after the long 1."""
    import xxhash

    def chain(*values) -> int:
        seed = 42
        for v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return seed
    return chain(key), chain(1, key)


def _slot_keys(h1: np.ndarray, h2: np.ndarray, part: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the perfect hash, and fingerprints."""
    a, b, part = h1.astype(np.uint64), h2.astype(np.uint64), part.astype(np.uint64)
    step = S.mix(part + np.uint64(0x632BE59BD9B4E019))
    return S.mix(a + step + np.uint64(salt) * S.mix(b)), S.mix(b ^ step)


def _write_shards(parts: Iterator[pa.RecordBatch], root: str, make, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Writes the rows of a task, sorted by key, as one shard; gives the entries."""
    shard, coder = TaskContext.get().partitionId(), C.coder_of_worker(make)
    first = next(parts, None)
    while first is not None and not first.num_rows:
        first = next(parts, None)
    if first is None:
        return
    open_entry = None  # (h1, h2, ordinal, offset, length, copies, ids) of the key that may go on in the next slice
    docs = ids = 0
    starts = []
    with NewFile(root, f"shard-{shard:08d}.ids") as out:
        for part in _chain(first, parts):
            h1, h2 = (part.column(c).to_numpy() for c in ("h1", "h2"))
            for row, scan in S.slices(part.column("__text"), TEXT_BYTES):
                flat, at = C.encode_rows(coder, scan.data, scan.row_start)
                if len(flat) and int(flat.max()) >> (8 * width):
                    raise ValueError(f"token ids do not fit in {width} bytes")
                out.write(np.insert(flat, at[1:], end_id).astype(f"<u{width}").tobytes())
                length = np.diff(at) + 1
                start = ids + np.cumsum(length) - length
                starts.append(start)
                a, b = h1[row: row + scan.rows], h2[row: row + scan.rows]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                edge = np.append(new, scan.rows)
                columns = [a[new], b[new], docs + new, start[new], length[new], np.diff(edge), np.add.reduceat(length, new)]
                if open_entry is not None:
                    if open_entry[0] == a[0] and open_entry[1] == b[0]:
                        merged = (*open_entry[:5], open_entry[5] + int(columns[5][0]), open_entry[6] + int(columns[6][0]))
                        for c, v in zip(columns, merged):
                            c[0] = v
                    else:
                        columns = [np.insert(c, 0, v) for c, v in zip(columns, open_entry)]
                open_entry = tuple(int(c[-1]) for c in columns)
                yield _entries(shard, [c[:-1] for c in columns])
                docs, ids = docs + scan.rows, ids + int(length.sum())
        out.write(np.append(np.concatenate(starts), ids).astype("<u8").tobytes())
        out.write(TRAILER.pack(SHARD_MAGIC, docs, ids))
    yield _entries(shard, [np.array([v]) for v in open_entry])


def _chain(first, rest):
    yield first
    yield from rest


def _entries(shard: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    h1, h2, *rest = (pa.array(c.astype(np.int64)) for c in columns)
    return pa.RecordBatch.from_arrays([h1, h2, pa.array(np.full(len(h1), shard, np.int32)), *rest],
                                      ["h1", "h2", "shard", "ordinal", "offset", "length", "copies", "ids"])


def _write_bucket(group: pa.Table, root: str) -> pa.Table:
    """Writes the index of one bucket."""
    column = {n: group.column(n).to_numpy() for n in group.column_names}
    order = np.lexsort((column["shard"], column["h2"], column["h1"]))
    column = {n: c[order] for n, c in column.items()}
    h1, h2, shard = column["h1"], column["h2"], column["shard"].astype(np.int64)
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    run = np.cumsum(new) - 1
    part = shard - shard[new][run]  # documents of one key fill neighbouring shards
    salt = 0
    while True:
        keys, prints = _slot_keys(h1, h2, part, salt)
        if len(np.unique(keys)) == len(keys):
            break
        salt += 1
    table = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = table.number(keys)
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    slots["fingerprint"][at], slots["parts"][at] = prints, (part[last] + 1)[run]
    for name in ("shard", "ordinal", "offset", "length", "copies"):
        slots[name][at] = column[name]
    bucket = int(column["bucket"][0])
    with NewFile(root, f"index-{bucket:08d}.mph") as out:
        out.write(HEADER.pack(INDEX_MAGIC, len(keys), salt, len(table.sizes)))
        out.write(table.sizes.astype("<u8").tobytes())
        out.write(table.bits.tobytes())
        out.write(slots.tobytes())
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})


class Bucket:
    """The index of one bucket, opened for reading; ``slots`` reads the slots of the given numbers."""

    def __init__(self, root: str, bucket: int):
        self.pages = Pages(root, f"index-{bucket:08d}.mph")
        magic, self.keys, self.salt, levels = HEADER.unpack(self.pages.read(0, HEADER.size))
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        sizes = np.frombuffer(self.pages.read(HEADER.size, 8 * levels), "<u8").astype(np.int64)
        begin = HEADER.size + 8 * levels
        self.table = PerfectHash(sizes, np.frombuffer(self.pages.read(begin, int(sizes.sum()) // 8), np.uint8))
        self.first = begin + int(sizes.sum()) // 8

    def find(self, h1: np.ndarray, h2: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and the slots of those."""
        keys, prints = _slot_keys(h1, h2, part, self.salt)
        number = self.table.number(keys)
        slots = np.zeros(len(keys), SLOT)
        hit = np.flatnonzero(number >= 0)
        if len(hit) > 64:
            slots[hit] = np.frombuffer(self.pages.read(self.first, SLOT.itemsize * self.keys), SLOT)[number[hit]]
        else:
            for i in hit:
                slots[i] = np.frombuffer(self.pages.read(self.first + SLOT.itemsize * int(number[i]), SLOT.itemsize), SLOT)[0]
        there = (number >= 0) & (slots["fingerprint"] == prints)
        return there, slots[there]


def _probe(group: pa.Table, root: str) -> pa.Table:
    """Entries of the keys of one bucket."""
    names = ["doc_id", "shard", "ordinal", "offset", "length", "copies"]
    try:
        bucket = Bucket(root, int(group.column("bucket")[0].as_py()))
    except FileNotFoundError:
        return group.select(["doc_id"]).slice(0, 0)
    h1, h2 = group.column("h1").to_numpy(), group.column("h2").to_numpy()
    there, slots = bucket.find(h1, h2, np.zeros(len(h1), np.int64))
    owner = np.flatnonzero(there)
    more = np.flatnonzero(slots["parts"] > 1)
    if len(more):
        count = slots["parts"][more].astype(np.int64) - 1
        again = np.repeat(owner[more], count)
        found, others = bucket.find(h1[again], h2[again], C.spread(np.ones(len(more), np.int64), count))
        owner, slots = np.concatenate([owner, again[found]]), np.concatenate([slots, others])
    bucket.pages.close()
    key = group.column("doc_id").take(pa.array(owner))
    return pa.table([key, *(pa.array(slots[n].astype(np.int32 if n == "shard" else np.int64)) for n in names[1:])], names)


class Shard:
    def __init__(self, store: Store, shard: int):
        self.pages, self.width = Pages(store.root, f"shard-{shard:08d}.ids"), store.width
        magic, self.docs, self.ids = TRAILER.unpack(self.pages.read(self.pages.size - TRAILER.size, TRAILER.size))
        if magic != SHARD_MAGIC:
            raise ValueError("not a shard file")

    def starts(self, ordinal: int, count: int) -> np.ndarray:
        """Starts of ``count`` documents from ``ordinal`` on, and the end of the last."""
        return np.frombuffer(self.pages.read(self.ids * self.width + 8 * ordinal, 8 * (count + 1)), "<u8").astype(np.int64)

    def read(self, start: int, count: int) -> np.ndarray:
        return np.frombuffer(self.pages.read(start * self.width, count * self.width), f"<u{self.width}").astype("<u4")


def _read(parts: Iterator[pa.RecordBatch], store: Store, payload: bool) -> Iterator[pa.RecordBatch]:
    """Documents of entries that come sorted by shard and place, in spans of neighbouring documents."""
    now, shard = None, None
    for part in parts:
        number = part.column("shard").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else []
        for low, high in zip(edges[:-1], edges[1:]):
            if now != number[low]:
                if shard:
                    shard.pages.close()
                now, shard = number[low], Shard(store, int(number[low]))
            rows = part.slice(low, high - low)
            copies, start, length = (rows.column(n).to_numpy() for n in ("copies", "offset", "length"))
            owner = np.repeat(np.arange(len(copies)), copies)
            begin, size = start[owner], length[owner]
            at = np.cumsum(copies) - copies
            for i in np.flatnonzero(copies > 1):
                run = shard.starts(int(rows.column("ordinal")[int(i)].as_py()), int(copies[i]))
                begin[at[i]: at[i] + copies[i]], size[at[i]: at[i] + copies[i]] = run[:-1], np.diff(run)
            yield from _documents(rows.column("doc_id"), owner, begin, size, int(now), shard, payload)


def _documents(key: pa.Array, owner: np.ndarray, begin: np.ndarray, size: np.ndarray, number: int, shard: Shard, payload: bool) -> Iterator[pa.RecordBatch]:
    gap, most = GAP_BYTES // shard.width, READ_BYTES // shard.width
    i = 0
    while i < len(begin):
        j = i + 1
        while j < len(begin) and 0 <= begin[j] - (begin[j - 1] + size[j - 1]) <= gap and begin[j] + size[j] - begin[i] <= most:
            j += 1
        ids = shard.read(int(begin[i]), int(begin[j - 1] + size[j - 1] - begin[i]))
        texts = [ids[b: b + n].tobytes() for b, n in zip(begin[i:j] - begin[i], size[i:j])]
        names = ["doc_id", "shard", "offset", "n_tokens", "ids_crc32"]
        arrays = [key.take(pa.array(owner[i:j])), pa.array(np.full(j - i, number, np.int32)), pa.array(begin[i:j]), pa.array(size[i:j]),
                  pa.array([zlib.crc32(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary())] if payload else arrays, [*names, "ids"] if payload else names)
        i = j


def write_ids(docs: DataFrame, root: str | None = None, make=C.default_coder, vocabulary: int = 50_257, end_id: int = END_ID) -> Store:
    """Encodes the texts of ``docs`` (doc_id, text) and writes them with their index to ``root``.

    ``make`` gives the coder of a worker; ``vocabulary`` bounds its ids and decides their width on disk.  A null text is
    empty: the end id alone.  Rows without doc_id come first under the key null; repeated doc_ids are stored side by
    side, and identical rows may be in any order.  Other columns are not read.  An empty table gives a store without
    shards.  ``root`` must be a new folder on storage that all executors reach.
    """
    spark = bound_batches(docs.sparkSession)
    root = root or f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    scratch = Scratch(spark, "ids")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    text = F.coalesce("text", F.lit("")).alias("__text")
    rows = docs.select("doc_id", *_hashes(), F.xxhash64("text").alias("__hash"), text)
    rows = rows.repartitionByRange(shards, "doc_id", "__hash", F.rand(0)).sortWithinPartitions("doc_id", "__hash", "__text")
    entries = rows.drop("__hash", "doc_id").mapInArrow(partial(_write_shards, root=root, make=make, width=width, end_id=end_id), ENTRY)
    entries = scratch.save(entries, "entries")
    store = Store(root, width, max(1, -(-entries.count() // BUCKET_KEYS)), end_id)
    build = entries.withColumn("bucket", F.pmod("h1", F.lit(store.buckets)).cast("int")).drop("ids").groupBy("bucket")
    scratch.save(build.applyInArrow(lambda group: _write_bucket(group, root), "bucket int, keys long"), "buckets")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    bases = entries.groupBy("shard").agg(F.sum("copies").alias("docs"), F.sum("ids").alias("ids"))
    bases = bases.select("shard", "docs", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    bases.write.mode("overwrite").parquet(f"{root}/shards")
    scratch.drop("entries", "buckets")
    with NewFile(root, "store.json") as out:
        out.write(json.dumps({"width": store.width, "buckets": store.buckets, "end_id": end_id}).encode())
    return store


def open_store(root: str) -> Store:
    pages = Pages(root, "store.json")
    return Store(root, **json.loads(pages.read(0, pages.size)))


def read_ids(spark: SparkSession, store: Store, keys: DataFrame, payload: bool = False) -> DataFrame:
    """Every stored document whose key stands in ``keys.doc_id``: doc_id, shard, start (ids of all documents before it),
    n_tokens, ids_crc32, and with ``payload`` the ids themselves (little-endian unsigned 32-bit).

    A key asked for twice is read once; one that is not stored gives no row.  Keys meet their bucket, and entries their
    shard, so that a file is opened by one task.
    """
    key_type = keys.schema["doc_id"].dataType.simpleString()
    asked = keys.select("doc_id").distinct().select("doc_id", *_hashes()).withColumn("bucket", F.pmod("h1", F.lit(store.buckets)).cast("int"))
    root = store.root
    found = asked.groupBy("bucket").applyInArrow(lambda group: _probe(group, root), f"doc_id {key_type}, shard int, ordinal long, offset long, length long, copies long")
    bases = spark.read.parquet(f"{store.root}/shards").select("shard", "base")
    placed = found.repartition("shard").sortWithinPartitions("shard", "ordinal")
    schema = f"doc_id {key_type}, shard int, offset long, n_tokens long, ids_crc32 long" + (", ids binary" if payload else "")
    read = placed.mapInArrow(partial(_read, store=store, payload=payload), schema)
    read = read.join(F.broadcast(bases), "shard")  # a row a shard
    return read.select("doc_id", "shard", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if payload else []))


def get(store: Store, key: int | None) -> list[np.ndarray]:
    """The ids of the documents under one integer key, by three short reads a document; none if the key is not stored."""
    h1, h2 = key_hashes(key)
    signed = h1 - (1 << 64) if h1 >> 63 else h1
    where, root = open_folder(store.root)
    name = signed % store.buckets
    if where.get_file_info(f"{root}/index-{name:08d}.mph").type.name == "NotFound":
        return []
    bucket, out, part, parts = Bucket(store.root, name), [], 0, 1
    while part < parts:
        there, slots = bucket.find(np.array([h1], np.uint64), np.array([h2], np.uint64), np.array([part]))
        if not there[0]:
            return out
        slot, parts = slots[0], int(slots["parts"][0])
        shard = Shard(store, int(slot["shard"]))
        if slot["copies"] == 1:
            out.append(shard.read(int(slot["offset"]), int(slot["length"])))
        else:
            run = shard.starts(int(slot["ordinal"]), int(slot["copies"]))
            out += [shard.read(int(a), int(b - a)) for a, b in zip(run[:-1], run[1:])]
        part += 1
    return out
