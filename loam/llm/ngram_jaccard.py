"""N-gram Jaccard join with prefix trees.

Two documents link when the Jaccard similarity of their sets of word shingles is at least a
threshold t. Documents of equal sets form a class; all steps work on classes.

1. Candidates. Sets are ordered by hash. Linked sets of n and m shingles share at least l shingles
   among the first n - ceil(tn) + l and m - ceil(tm) + l. These prefixes are dealt out by ranges of
   shingles (what repeats within a batch is combined before, so a frequent shingle is one entry of a
   batch), and a class goes on only if so many shingles of its prefix stand in other classes.
2. Profiles. The document frequencies of all shingles of the candidates give the global order, rare
   ones first. Shingles of one class only cannot be shared and go; a class with fewer than tn others
   goes too. What is left is exact: intersections of profiles are intersections of the sets.
3. Blocks. Linked classes share a shingle of their profiles' prefixes in the global order, so the
   components over these shingles hold all links. Components of more than BLOCK classes are dealt
   into chunks, and each pair of chunks is a block.
4. Prefix trees. In a block the sets form a trie, frequent shingles first, whose depth-first walk
   keeps the overlaps with all sets of the block at each branch: sets below a branch share them.
   A branch is left, with all below it, when for no set the overlap so far and what remains, at
   the longest, reach what the smallest set below needs, or when those that do are linked already.
5. Links of blocks are joined to components where components were split.

Words are hashed and shingles made for a whole batch of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, trim_memory
from .components import connected
from .words import Keys, byte_table, padded, runs, slabs

#: Classes of a block; rows of one shingle held in memory; frequencies from which shingles count as equally frequent.
BLOCK, HELD, FREQUENT = 1024, 500_000, 1000
#: Ids of candidate classes sent to every worker (8 bytes each); with more, they are joined instead.
MOST_BROADCAST = 4_000_000


#: Shingles of a batch; classes that a task remembers to skip copies; ranges of shingles for each partition.
BATCH, SEEN, RANGES = 1_000_000, 200_000, 8
_TABLE = byte_table(SPACES.encode(), lower=True)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts after the other: sorted 64-bit hashes of the distinct shingles of ``size`` words of
    each, and the bounds of each text's. Fewer words are one shingle; null, empty and blank texts have none."""
    for _, raw, bounds in slabs(texts):
        data = padded(raw.translate(_TABLE))  # bytes: only A-Z is lower-cased and only ASCII spaces split
        starts, ends, first = runs(data[: len(raw)] != 32, bounds)
        words, counts = Keys(data, starts, ends).hash, np.diff(first)
        rolling, out = words.copy(), np.zeros(len(words), np.uint64)
        valid = np.zeros(len(words), bool)
        for k in range(1, size + 1):
            if k > 1:  # rolling[i]: hash of the k words from i
                rolling = rolling[:-1]
                rolling *= np.uint64(0x9E3779B97F4A7C15)
                rolling ^= rolling >> np.uint64(29)
                rolling += words[k - 1 :]
            if k < size:
                at = first[:-1][counts == k]
                out[at] = rolling[at] ^ np.uint64(0xC2B2AE3D27D4EB4F * (size - k) % (1 << 64))
                valid[at] = True
            else:
                left = np.repeat(first[1:], counts)[: len(rolling)] - np.arange(len(rolling))  # words from here to the text's end
                full = np.flatnonzero(left >= size)
                out[full] = rolling[full]
                valid[full] = True
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        values = out[valid].view(np.int64)
        stops = np.concatenate([[0], np.cumsum(valid)])[first]
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            values[a:b].sort()
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[stops[:-1][stops[:-1] < len(values)]] = True
        yield values[new], np.concatenate([[0], np.cumsum(new)])[stops]


def class_of(found: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of it."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def classes_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of each text's set; 0 for those without shingles."""
    ends = bounds.tolist()
    return np.array([class_of(values[a:b]) if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)


def least(n, percent: int):
    """Shingles that a set of n must share with a linked one."""
    return -(-percent * n // 100)


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    stops = np.cumsum(counts)
    return np.repeat(begins - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)


def _classes(batches: Iterator[pa.RecordBatch], size: int, ids: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, sizes, shingles) of some texts after the other, mostly each class once for each task;
    with ``ids`` (sorted) only these classes."""
    seen: set[int] = set()
    for batch in batches:
        for values, bounds in shingle_sets(batch.column(0), size):
            cls, n = classes_of(values, bounds), np.diff(bounds)
            good = n > 0
            if ids is not None:
                at = np.searchsorted(ids, cls)
                good &= (ids[np.minimum(at, len(ids) - 1)] == cls) if len(ids) else False
            for i in np.flatnonzero(good).tolist():
                c = int(cls[i])
                good[i] = c not in seen
                seen.add(c)
            if len(seen) > SEEN:
                seen.clear()
            if good.any():
                yield cls[good], n[good], values[_ranges(bounds[:-1][good], n[good])]
    trim_memory()


def _runs(batches: Iterator[pa.RecordBatch], key: str = "token") -> Iterator[tuple[dict, bool]]:
    """Columns (numpy) of sorted rows in chunks that hold whole groups of ``key``. A group of more than
    HELD rows comes in parts, each a chunk of its own, marked True."""
    held, hot = None, None
    for batch in batches:
        now = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        if hot is not None:
            same = int(np.searchsorted(now[key], hot, "right"))
            if same:
                yield {k: v[:same] for k, v in now.items()}, True
                now = {k: v[same:] for k, v in now.items()}
            if len(now[key]):
                hot = None
        if held is not None:
            now = {k: np.concatenate([held[k], v]) for k, v in now.items()}
        if not len(now[key]):
            held = None
            continue
        cut = int(np.searchsorted(now[key], now[key][-1], "left"))
        if cut:
            yield {k: v[:cut] for k, v in now.items()}, False
        held = {k: v[cut:] for k, v in now.items()}
        if len(held[key]) > HELD:
            hot = held[key][0]
            yield held, True
            held = None
    if held is not None:
        yield held, False


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict]:
    """As ``_runs``, but a group of more than HELD rows comes in one chunk too."""
    parts = []
    for rows, hot in _runs(batches, key):
        if parts and not (hot and rows[key][0] == parts[0][key][0]):
            yield {k: np.concatenate([x[k] for x in parts]) for k in rows}
            parts = []
        if hot:
            parts.append(rows)
        else:
            yield rows
    if parts:
        yield {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _packed(names: list[str], bucket: np.ndarray, kind: int, offsets: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Rows of (bucket, kind, 64-bit values as binary columns)."""
    columns = [pa.BinaryArray.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer((8 * offsets).astype(np.int32).tobytes()), pa.py_buffer(x.astype(np.int64).tobytes())]) for x in values]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), kind, np.int8)), *columns], names=["bucket", "kind", *names])


def _flat(column: pa.Array) -> np.ndarray:
    """The 64-bit values of all rows of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int64, (int(offsets[-1]) - int(offsets[0])) // 8, int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, np.int64)


def _candidates(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``cls`` of the classes that may have links (step 1)."""
    buckets = RANGES * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt_out(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cls, n, prefix = (np.concatenate(x) for x in zip(*held, strict=True))
        own = np.repeat(np.arange(len(cls)), n - least(n, percent) + np.maximum(1, n // 8))
        order = np.argsort(prefix)
        token, own = prefix[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        times = np.diff(np.append(starts, len(token)))
        # once in the batch: the token with its class; more often: once with class 0, and counted here for its classes
        shared = np.bincount(own[np.repeat(times > 1, times)], minlength=len(cls))
        token, of = token[starts], np.where(times > 1, 0, cls[own[starts]])
        where = ((token >> 32) + (1 << 31)) * buckets >> 32  # ranges of tokens, in order
        edges = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
        yield _packed(["token", "cls"], where[edges[:-1]], 0, edges, token, of)
        yield _packed(["token", "cls"], np.array([int(cls[0]) % buckets]), 1, np.array([0, len(cls)]), cls, shared << 40 | n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for cls, n, values in _classes(batches, size):
            p = n - least(n, percent) + np.maximum(1, n // 8)  # a part of n, or all of a set of few shingles
            p = np.minimum(p, n)
            held.append((cls, n, values[_ranges(np.cumsum(n) - n, p)]))
            total += int(p.sum())
            if total > BATCH:
                yield from dealt_out(held)
                held, total = [], 0
        if held:
            yield from dealt_out(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made() -> pa.RecordBatch:
            token, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(token)
            token, cls = token[order], cls[order]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.minimum.reduceat(cls, starts) != np.maximum.reduceat(cls, starts)
            many |= np.logical_or.reduceat(cls == 0, starts)
            inside = np.repeat(many, np.diff(np.append(starts, len(token)))) & (cls != 0)
            token, cls = token[inside], cls[inside]
            order = np.lexsort((token, cls))
            token, cls = token[order], cls[order]
            new = np.ones(len(cls), bool)
            new[1:] = (cls[1:] != cls[:-1]) | (token[1:] != token[:-1])  # copies of a class come from several tasks
            names, times = np.unique(cls[new], return_counts=True)
            return _batch(cls=names, k=times.astype(np.int32), n=np.zeros(len(names), np.int64))

        for batch in batches:
            at = batch.column("bucket").to_numpy()
            kinds = batch.column("kind").to_numpy()
            for i in range(batch.num_rows):
                token, cls = (_flat(batch.column(x).slice(i, 1)) for x in ("token", "cls"))
                if kinds[i]:
                    yield _batch(cls=token, k=(cls >> 40).astype(np.int32), n=cls & (1 << 40) - 1)
                    continue
                if at[i] != key and held:
                    yield made()
                    held = []
                key = at[i]
                held.append((token, cls))
        if held:
            yield made()
        trim_memory()

    dealt = texts.mapInArrow(deal, "bucket int, kind tinyint, token binary, cls binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(count, "cls bigint, k int, n bigint").groupBy("cls").agg(F.sum("k").alias("k"), F.max("n").alias("n"))
    fewest = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 8))  # a linked set may be smaller
    return materialise(counts.where(F.col("k") >= fewest).select("cls"), "candidates")


def _profiles(texts: DataFrame, candidates: DataFrame, size: int, percent: int) -> DataFrame:
    """``cls, n, q, tokens``: shared shingles, rare first; the first q are the prefix (step 2)."""
    few = candidates.count() <= MOST_BROADCAST
    ids = np.sort(candidates.toArrow().column(0).to_numpy()) if few else None
    sent = texts.sparkSession.sparkContext.broadcast(ids)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, n, values in _classes(batches, size, sent.value):
            yield _batch(token=values, cls=np.repeat(cls, n), n=np.repeat(n.astype(np.int32), n))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hot in _runs(batches):
            token, cls, n = rows["token"], rows["cls"], rows["n"]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])
            token, cls, n = token[new], cls[new], n[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            counts = np.diff(np.append(starts, len(token)))
            df = np.full(len(token), FREQUENT) if hot else np.minimum(np.repeat(counts, counts), FREQUENT)
            keep = df > 1
            if keep.any():
                yield _batch(cls=cls[keep], df=df[keep].astype(np.int32), token=token[keep], n=n[keep])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, "cls"):
            starts = np.flatnonzero(np.concatenate([[True], rows["cls"][1:] != rows["cls"][:-1]]))
            m, n = np.diff(np.append(starts, len(rows["cls"]))), rows["n"][starts].astype(np.int64)
            q = m - least(n, percent) + 1
            good = q > 0
            if good.any():
                held = np.repeat(good, m)
                offsets = np.concatenate([[0], np.cumsum(m[good])]).astype(np.int32)
                yield _batch(cls=rows["cls"][starts][good], n=n[good].astype(np.int32), q=q[good].astype(np.int32), tokens=pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows["token"][held])))

    dealt = texts.mapInArrow(deal, "token bigint, cls bigint, n int")
    if not few:
        dealt = dealt.join(candidates, "cls", "left_semi").select("token", "cls", "n")
    counted = dealt.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(frequency, "cls bigint, df int, token bigint, n int")
    ordered = counted.repartition("cls").sortWithinPartitions("cls", "df", "token")
    return materialise(ordered.mapInArrow(gather, "cls bigint, n int, q int, tokens array<bigint>"), "profiles")


def trie_links(cls: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each class of a block the smallest class that it reaches by links inside the block.

    ``sizes`` are the whole sets' sizes, ``sets`` their shared shingles in any order.
    """
    g = len(sets)
    names, local, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -times))] = np.arange(len(names))  # frequent first
    owner = np.repeat(np.arange(g), [len(x) for x in sets])
    ranked = rank[local]
    order = np.lexsort((owner, ranked))
    members, bounds = owner[order], np.searchsorted(ranked[order], np.arange(len(names) + 1))  # sets that hold each shingle
    paths = [np.sort(x) for x in np.split(ranked, np.cumsum([len(x) for x in sets])[:-1])]
    walk = np.array(sorted(range(g), key=lambda i: paths[i].astype(">u4").tobytes()))
    length = np.array([len(x) for x in paths])
    common = np.array([_alike(paths[i], paths[j]) for i, j in zip(walk[:-1], walk[1:], strict=True)], np.int64)  # shingles that neighbours begin with
    group = np.arange(g)  # the sets that links join so far

    def add(overlap: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not len(part):
            return overlap
        return overlap + np.bincount(members[_ranges(bounds[part], bounds[part + 1] - bounds[part])], minlength=g)

    branches = [(0, g, 0, np.zeros(g, np.int64))]  # the sets walk[lo:hi] begin with `depth` equal shingles, of which the others hold `overlap`
    while branches:
        lo, hi, depth, overlap = branches.pop()
        below = walk[lo:hi]
        if hi - lo == 1:
            i = int(below[0])
            need = -(-percent * (sizes[i] + sizes) // (100 + percent))
            may = (overlap + np.minimum(length[i] - depth, length - overlap) >= need) & (group != group[i])
            if may.any():
                overlap = add(overlap, paths[i][depth:])
                for other in np.unique(group[may & (overlap >= need)]).tolist():
                    group[group == other] = group[i]
            continue
        shared = int(common[lo : hi - 1].min())
        overlap = add(overlap, paths[below[0]][depth:shared])
        need = -(-percent * (sizes[below].min() + sizes) // (100 + percent))
        may = overlap + np.minimum(length[below].max() - shared, length - overlap) >= need
        if (group[below] == group[below[0]]).all():
            may &= group != group[below[0]]
        if not may.any():
            continue
        edges = [lo, *(np.flatnonzero(common[lo : hi - 1] == shared) + lo + 1).tolist(), hi]
        branches += [(a, b, shared, overlap) for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True)]
    lowest = np.full(g, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, cls)
    return lowest[group]


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers both begin with."""
    k = min(len(x), len(y))
    unlike = np.flatnonzero(x[:k] != y[:k])
    return int(unlike[0]) if len(unlike) else k


def _linked(profiles: DataFrame, percent: int) -> DataFrame:
    """``cls, root`` for the classes with links to others (steps 3 to 5)."""
    prefix = profiles.select("cls", F.explode(F.slice("tokens", F.lit(1), F.col("q"))).alias("token"))
    first = prefix.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("token", "low")
    near = connected(prefix.join(first, "token").select(F.col("cls").alias("a"), F.col("low").alias("b")))
    near = materialise(near, "near")
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    chunks = F.ceil(F.col("members") / BLOCK)
    spread = near.join(sizes, "root").select("root", F.col("node").alias("cls"), chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).alias("c"))
    split = spread.where("chunks > 1").limit(1).count() > 0
    other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), lambda x: x != F.col("c"))
    keys = F.when(F.col("chunks") > 1, F.transform(other, lambda x: F.struct(F.least(x, F.col("c")).alias("x"), F.greatest(x, F.col("c")).alias("y")))).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))))
    blocks = spread.select("root", "cls", F.explode(keys).alias("b")).select("root", "b.x", "b.y", "cls").join(profiles.select("cls", "n", "tokens"), "cls")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []

        def made() -> pa.RecordBatch:
            cls, n, sets = zip(*block, strict=True)
            roots = trie_links(np.array(cls, np.int64), np.array(n, np.int64), list(sets), percent)
            return _batch(cls=np.array(cls, np.int64), root=roots)

        for batch in batches:
            tokens = batch.column("tokens")
            values, offsets = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(tokens.offsets.to_numpy()))])
            for k, (root, x, y, cls, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y", "cls", "n")), strict=True)):
                if (root, x, y) != key:
                    if len(block) > 1:
                        yield made()
                    key, block = (root, x, y), []
                block.append((cls, n, values[offsets[k] : offsets[k + 1]].copy()))
        if len(block) > 1:
            yield made()

    ordered = blocks.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "cls").select("root", "x", "y", "cls", "n", "tokens")
    links = ordered.mapInArrow(join, "cls bigint, root bigint").where("cls != root")
    if split:
        links = connected(links.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), "root")
    return materialise(links, "links")


def ngram_jaccard(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are runs of other characters than U+0020 and U+0009 to U+000D, A-Z lower-cased. A document's
    set has its distinct shingles of ``size`` words, with fewer words the whole sequence as one; null,
    empty and blank texts have none and link with nothing. Documents link when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest doc_id reachable by links, itself included
    (null ids count only where no other is). Rows that repeat an id are handled apart. An empty
    table gives no rows; other columns are ignored. Shingles and sets are compared by 64-bit hashes.
    Bytes that aren't UTF-8 are bytes of words like any other.

    With ``row_id``, a bigint column that numbers the rows, also ``row`` and ``keep_row``: the row of
    the smallest doc_id of the component (null ids last), of equal ids the smallest row.
    """

    def size_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for values, bounds in shingle_sets(batch.column(1), size):
                n = np.diff(bounds)
                head = [x.slice(row, len(n)) for x in (batch.column(0), *batch.columns[2:])]
                yield pa.RecordBatch.from_arrays([head[0], pa.array(n, pa.int64()), pa.array(classes_of(values, bounds), mask=n == 0), *head[1:]], names=["doc_id", "n_shingles", "cls", *batch.schema.names[2:]])
                row += len(n)
        trim_memory()

    more = [] if row_id is None else [row_id]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(x).cast("bigint").alias("row") for x in more])
    texts = rows.select("text").where(F.col("text").isNotNull())
    classes = materialise(rows.mapInArrow(size_of, "doc_id bigint, n_shingles bigint, cls bigint" + (", row bigint" if more else "")), "classes")
    links = _linked(_profiles(texts, _candidates(texts, size, percent), size, percent), percent)
    # by class, then by component: rows of copies are combined before they are shuffled; only classes that move are joined to rows
    per = classes.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("members"), *[F.min(_first("row")).alias("first") for _ in more])
    rooted = materialise(per.join(links, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"), F.sum("members").alias("together"), *[F.min("first").alias("keeps") for _ in more]).where("together > 1")
    moved = materialise(lowest, "lowest").join(rooted.select("cls", "root"), "root").select("cls", "component", *(["keeps"] if more else []))
    moved = materialise(moved, "moved")
    own = F.col("doc_id").alias("component_id")
    alone = classes.where(F.col("cls").isNull()).select("doc_id", "n_shingles", own, *(["row", F.col("row").alias("keep_row")] if more else []))
    found = classes.where(F.col("cls").isNotNull()).join(moved, "cls", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *(["row", F.coalesce("keeps.row", "row").alias("keep_row")] if more else []))
    return found.unionByName(alone)


def _first(row: str):
    """Orders the rows of a class: by doc_id, null last, then by row."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col(row))
