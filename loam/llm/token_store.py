"""A content-addressed store of token ids.

A store is a folder of three Parquet tables:

``chunks``     digest, n, data: each distinct chunk of ids once; data holds the ids as little-endian
               unsigned integers of 2 bytes (4 where the vocabulary needs them)
``documents``  in ascending doc_id order, null last: part, row, doc_id, before (ids of the part's
               documents before it), n_tokens, chunks (its recipe: digests in order), sizes, root (of
               the Merkle tree over the recipe), part_root (of the tree over the part's documents; in
               its last row)
``manifest``   part, offset (ids of all parts before it), n_docs, n_tokens, root

Chunks end where a rolling hash of the last 16 ids of a document is 0 in its lowest bits, so equal
passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_path
from .encoding import encoder

WINDOW, LEAST, MEAN, MOST = 16, 256, 1024, 4096
#: Digests that occur again, sent to every worker; with more of them, chunks are shuffled instead.
MOST_BROADCAST = 300_000

ENCODED = "doc_id bigint, shard int, row bigint, n_tokens int, chunks array<binary>, sizes array<int>, data binary"
RECIPES = "part int, row bigint, doc_id bigint, before bigint, n_tokens int, chunks array<binary>, sizes array<int>, root binary, part_root binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of each document's chunks, by its ids alone; ``bounds`` are the documents' in ``ids``."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    step, power = 1, 0xD6E8FEB86659FD93
    while step < WINDOW:  # h[i]: polynomial hash of the last `step` ids, whose first LEAST places in a document don't count
        more = h.copy()
        more[step:] += h[:-step] * np.uint64(power)
        h, step, power = more, step * 2, power * power % (1 << 64)
    h ^= h >> np.uint64(29)
    marks = np.flatnonzero((h & np.uint64(MEAN - 1)) == 0) + 1
    ranges = np.searchsorted(marks, bounds, "right").tolist()
    marks, found = marks.tolist(), []
    for k, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        out, last, n = [], 0, end - begin
        for mark in marks[ranges[k] : ranges[k + 1]] if n > LEAST else ():
            at = mark - begin
            if at - last < LEAST:
                continue
            while at - last > MOST:
                last += MOST
                out.append(last)
            if at - last >= LEAST:
                out.append(at)
                last = at
        while n - last > MOST:
            last += MOST
            out.append(last)
        if last < n or not n:
            out.append(n)
        found.append(out)
    return found


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its ids, cut into chunks; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, shard, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = library.width
        for batch in batches:
            begin = 0
            for ids, stops, _, _ in library.encode(batch.column(1)):
                n = len(stops) - 1
                ids, bounds = np.insert(ids, stops[1:], end_id), stops + np.arange(n + 1)
                data = ids.astype(f"<u{width}").tobytes()
                names, sizes, counts = [], [], [0]
                for base, ends in zip(bounds.tolist(), cuts(ids, bounds), strict=False):
                    last = 0
                    for at in ends:
                        names.append(digest(data[(base + last) * width : (base + at) * width]))
                        sizes.append(at - last)
                        last = at
                    counts.append(len(names))
                lists = pa.array(counts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, n), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n)), pa.array(np.diff(bounds).astype(np.int32)),
                        pa.ListArray.from_arrays(lists, pa.array(names, pa.binary())), pa.ListArray.from_arrays(lists, pa.array(sizes, pa.int32())),
                        pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(data)]),
                    ],
                    names=["doc_id", "shard", "row", "n_tokens", "chunks", "sizes", "data"],
                )
                begin, row = begin + n, row + n

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def _chunk_rows(encoded: DataFrame, owners: dict[bytes, tuple[int, int, int]] | None) -> DataFrame:
    """(digest, n, data) of each chunk; with ``owners``, repeated chunks come from their owner only."""
    known = encoded.sparkSession.sparkContext.broadcast(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = known.value or {}
        for batch in batches:
            out = []
            for shard, row, chunks, sizes, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                at, width = 0, len(data) // max(1, sum(sizes))
                for k, (name, n) in enumerate(zip(chunks, sizes, strict=True)):
                    if owner.get(name, (shard, row, k)) == (shard, row, k):
                        out.append((name, n, data[at : at + n * width]))
                    at += n * width
            name, n, data = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["digest", "n", "data"])

    return encoded.select("shard", "row", "chunks", "sizes", "data").mapInArrow(run, "digest binary, n int, data binary")


def _recipes(encoded: DataFrame) -> DataFrame:
    """Sorted by doc_id over all partitions, with running counts and roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before, roots, held = TaskContext.get().partitionId(), 0, 0, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield held[0]
            sizes, mine = batch.column("n_tokens").to_pylist(), [merkle_root(x) for x in batch.column("chunks").to_pylist()]
            starts = np.cumsum([before, *sizes])
            roots += mine
            columns = [pa.array([part] * len(mine), pa.int32()), pa.array(range(row, row + len(mine)), pa.int64()), batch.column("doc_id"), pa.array(starts[:-1], pa.int64()), batch.column("n_tokens"), batch.column("chunks"), batch.column("sizes"), pa.array(mine, pa.binary())]
            row, before = row + len(mine), int(starts[-1])
            names = ["part", "row", "doc_id", "before", "n_tokens", "chunks", "sizes", "root", "part_root"]
            held = pa.RecordBatch.from_arrays([*columns, pa.nulls(len(mine), pa.binary())], names=names), columns, names
        if held:
            last = pa.array([*[None] * (held[0].num_rows - 1), merkle_root(roots)], pa.binary())
            yield pa.RecordBatch.from_arrays([*held[1], last], names=held[2])

    ordered = encoded.select("doc_id", "n_tokens", "chunks", "sizes", "shard", "row").repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("shard"), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "shard", "row")
    return ordered.select("doc_id", "n_tokens", "chunks", "sizes").mapInArrow(run, RECIPES)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` to each, and writes a store to ``path``.

    Every row is a document: rows that repeat an id stand next to each other, those without one
    come last. An empty table gives empty tables. Other columns are ignored, whatever their names.
    """
    encoded = materialise(encode(docs, tokenizer, end_id, id_col, text_col), "encoded")
    names = encoded.select("shard", "row", F.posexplode("chunks").alias("k", "digest"))
    again = names.groupBy("digest").agg(F.min(F.struct("shard", "row", "k")).alias("owner"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    again = materialise(again, "again")
    if again.count() <= MOST_BROADCAST:
        sent = again.select("digest", "owner.shard", "owner.row", "owner.k").toArrow()
        chunks = _chunk_rows(encoded, dict(zip(sent["digest"].to_pylist(), zip(*(sent[x].to_pylist() for x in ("shard", "row", "k")), strict=True), strict=True)))
    else:
        chunks = _chunk_rows(encoded, None).dropDuplicates(["digest"])
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    _recipes(encoded).write.option("compression", "zstd").parquet(f"{path}/documents")
    per = docs.sparkSession.read.schema(RECIPES).parquet(f"{path}/documents").groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("part_root").alias("root"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part file
    per.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"), "n_docs", "n_tokens", "root").write.parquet(f"{path}/manifest")


_POLY, _X = 0xEDB88320, None


def _times(a: int, b: np.ndarray) -> np.ndarray:
    """Product modulo the CRC-32 polynomial, bits reversed; ``a`` is one number."""
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> np.uint32(1)) ^ (b & np.uint32(1)) * np.uint32(_POLY)
    return out


def crc_moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a CRC-32 adds (by exclusive or) to that of a text in which ``n_bytes`` bytes follow."""
    global _X
    if _X is None:
        _X = [1 << 30]
        for _ in range(66):
            _X.append(int(_times(_X[-1], np.array([_X[-1]], np.uint32))[0]))
    out, n, k = crc.astype(np.uint32), n_bytes.astype(np.int64), 3
    while n.any():
        out = np.where(n & 1, _times(_X[k], out), out).astype(np.uint32)
        n, k = n >> 1, k + 1
    return out


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises if a part's documents and the manifest differ: lost, added or moved rows, counts, offsets, roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, roots, tokens, sound, stored = None, [], 0, True, None

        def made() -> pa.RecordBatch:
            ok = sound and stored == merkle_root(roots)
            columns = [pa.array([key], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([merkle_root(roots)], pa.binary()), pa.array([ok])]
            return pa.RecordBatch.from_arrays(columns, names=["part", "docs", "tokens", "found", "sound"])

        for batch in batches:
            for part, row, before, n, root, part_root in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != key:
                    if key is not None:
                        yield made()
                    key, roots, tokens, sound, stored = part, [], 0, True, None
                sound = sound and stored is None and row == len(roots) and before == tokens
                roots.append(root)
                tokens, stored = tokens + n, part_root
        if key is not None:
            yield made()

    rows = spark.read.schema(RECIPES).parquet(f"{path}/documents").select("part", "row", "before", "n_tokens", "root", "part_root")
    facts = rows.repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, "part int, docs bigint, tokens bigint, found binary, sound boolean")
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "offset", "n_docs", "n_tokens", "root")
    before = 0
    for x in sorted(manifest.join(facts, "part", "full").collect(), key=lambda x: x.part):  # one row for each part file
        if not x.sound or (x.offset, x.n_docs, x.n_tokens, x.root) != (before, x.docs, x.tokens, x.found):
            raise ValueError(f"part {x.part} of the documents is damaged or differs from the manifest")
        before += x.tokens


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Reads a store back: ``doc_id, start, n_tokens, ids_crc32`` per document.

    Every chunk's data is hashed and compared with its digest, and every recipe with its Merkle
    root; a chunk that is missing, of another size or damaged raises an error. So does a part whose
    documents differ from the manifest, at once. The CRC-32 of a
    document's ids as little-endian unsigned 32-bit integers is put together from those of its
    stored chunks, so no document's ids need to meet in one place.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ns, crcs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for name, n, data in zip(names, ns, batch.column(2).to_pylist(), strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (leaves, root) in enumerate(zip(batch.column("chunks").to_pylist(), batch.column("root").to_pylist(), strict=True)):
                if merkle_root(leaves) != root:
                    raise ValueError(f"the recipe of document {batch.column('doc_id')[row]} is damaged")
            sizes = batch.column("sizes")
            each, bounds = sizes.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes.value_lengths().to_numpy())])
            upto = np.concatenate([[0], np.cumsum(each)])
            total = upto[bounds[1:]] - upto[bounds[:-1]]
            if (wrong := np.flatnonzero(total != batch.column("n_tokens").to_numpy())).size:
                raise ValueError(f"the recipe of document {batch.column('doc_id')[int(wrong[0])]} has another length")
            after = np.repeat(upto[bounds[1:]], np.diff(bounds)) - upto[1:]  # ids after each chunk of its document
            yield batch.drop_columns(["root"]).append_column("after", pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(after)))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = crc_moved(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
            yield batch.drop_columns(["crc", "after"]).append_column("crc", pa.array(crc, pa.int64()))

    check_manifest(spark, path)
    chunks = spark.read.schema("digest binary, n int, data binary").parquet(f"{path}/chunks").mapInArrow(facts, "digest binary, n int, crc bigint")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/documents").select("part", "row", "doc_id", "before", "n_tokens", "chunks", "sizes", "root")
    recipes = recipes.mapInArrow(checked, "part int, row bigint, doc_id bigint, before bigint, n_tokens int, chunks array<binary>, sizes array<int>, after array<bigint>")
    links = recipes.select("part", "row", "doc_id", "before", "n_tokens", F.explode(F.arrays_zip("chunks", "sizes", "after")).alias("c"))
    links = links.select("part", "row", "doc_id", "before", "n_tokens", F.col("c.chunks").alias("digest"), F.col("c.sizes").alias("size"), F.col("c.after").alias("after"))
    joined = links.join(chunks, "digest", "left")
    sound = F.when(F.col("n") == F.col("size"), F.col("crc")).otherwise(F.raise_error(F.concat(F.lit("missing chunk "), F.hex("digest"))).cast("bigint"))
    parts = joined.select("part", "row", "doc_id", "before", "n_tokens", "after", sound.alias("crc")).mapInArrow(moved, "part int, row bigint, doc_id bigint, before bigint, n_tokens int, crc bigint")
    per = parts.groupBy("part", "row", "doc_id", "before", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "offset")
    return per.join(manifest, "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id, ids`` rebuilt from recipes and chunks, of all documents or those in ``wanted`` (doc_id)."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/documents")
    if wanted is not None:
        recipes = recipes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    links = recipes.select("part", "row", "doc_id", F.posexplode("chunks").alias("k", "digest"))
    rows = links.join(spark.read.schema("digest binary, n int, data binary").parquet(f"{path}/chunks"), "digest")
    per = rows.groupBy("part", "row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "n", "data"))).alias("c"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(x["data"], f"<u{len(x['data']) // x['n']}") for x in c]) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return per.select("doc_id", "c").mapInArrow(join, "doc_id bigint, ids array<bigint>")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes a store (to the shared folder if no ``path`` is given) and returns what ``verify`` reads back."""
    path = path or shared_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, end_id)
    return verify(docs.sparkSession, path)
