"""Benchmark decontamination by a generalised suffix automaton.

The automaton knows every run of words of every test item. A document's words are streamed through
it; its state and the length of the longest match give, at each word, all windows that end there.
Before, runs of words that can match are found for whole batches of texts: a window's word pairs must
all be pairs of some item. Items are read in blocks of bounded size, one automaton each, whose edges
are arrays, so that what is sent to the workers has a bound. With several blocks, documents are read
once for each, and only the rows that are hit are written, with their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, trim_memory
from .words import Table, padded, runs, slabs

#: Separators (all ASCII but letters and digits) to spaces, A-Z to a-z; bytes from 0x80 are word characters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Characters of item texts in one automaton (about 60 MB in a worker); rows that are hit in one of several blocks and
#: are sent to every task (with more, they are joined by a shuffle).
BLOCK, MOST_BROADCAST = 1_000_000, 50_000
FOUND = "doc_id bigint, text string, n_words bigint, n_hit bigint, items array<string>, spans array<struct<a:int,b:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """All runs of the items' words. ``window``: words of a window; a shorter item is one window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, numbers = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        ends: list[set[int]] = [set()]
        whole: dict[int, set[int]] = {}  # state of a short item's whole text
        self.names = [name for name, _ in items]
        pairs = set()
        self.least = window
        for item, (_, ws) in enumerate(items):
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in ws]
            if not ids:
                continue
            self.least = min(self.least, len(ids))
            pairs.update(zip(ids, ids[1:], strict=False))
            last, path = 0, []
            for c in ids:
                last = self._add(last, c, ends)
                path.append(last)
            for s in path:
                ends[s].add(item)
            if len(ids) < window:
                whole.setdefault(path[-1], set()).add(item)
        for s in sorted(range(len(self.long)), key=self.long.__getitem__, reverse=True):  # a state's items also end its suffixes
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        # of the states that hold runs of `window` words: the items they stand in; of each state: the short items it ends with
        self.items = {s: frozenset(ends[s]) for s in range(1, len(self.long)) if self.long[self.link[s]] < window <= self.long[s]}
        self.short: dict[int, tuple] = {}
        for s in sorted(range(len(self.long)), key=self.long.__getitem__):
            own = tuple((self._length(items, i), i) for i in sorted(whole.get(s, ())))
            if found := (self.short.get(self.link[s], ()) if s else ()) + own:
                self.short[s] = found
        bits = max(12, (8 * len(pairs)).bit_length())
        self.mask = (1 << bits) - 1
        self.pairs = np.zeros(1 << bits, bool)
        for a, b in pairs:
            self.pairs[(a * 0x9E3779B1 + b) & self.mask] = True
        # words: their numbers from 0 in a table of their bytes; edges: state and word in one key, sorted
        raw = b" ".join(numbers)
        self.table = Table(None)
        self.table.numbers(*_places(raw)[:3])
        edges = sorted((s << 32 | c, t) for s, found in enumerate(self.next) for c, t in found.items())
        self.edges, self.to = np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int32)
        self.next, self.link, self.long = [], np.array(self.link, np.int32), np.array(self.long, np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_steps"}

    @staticmethod
    def _length(items, i) -> int:
        return len(items[i][1])

    def _add(self, last: int, c: int, ends) -> int:
        nxt, link, long = self.next, self.link, self.long
        if c in nxt[last]:
            q = nxt[last][c]
            return q if long[q] == long[last] + 1 else self._split(last, c, q, ends)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        long.append(long[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if long[q] == long[p] + 1 else self._split(p, c, q, ends)
        return new

    def _split(self, p: int, c: int, q: int, ends) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.long.append(self.long[p] + 1)
        ends.append(set())
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def steps(self) -> tuple[dict[int, int], list[int], list[int]]:
        """Edges, links and lengths as Python looks them up fastest; made once in a worker."""
        if "_steps" not in self.__dict__:
            self._steps = dict(zip(self.edges.tolist(), self.to.tolist(), strict=True)), self.link.tolist(), self.long.tolist()
        return self._steps

    def candidates(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Runs of words (first, behind the last) of single texts, at least as long as the shortest window, in which a
        window can stand."""
        known, more = ids > 0, 0
        if self.least > 1:
            more, good = 1, np.zeros(len(ids), bool)
            good[:-1] = known[:-1] & known[1:] & self.pairs[(ids[:-1] * 0x9E3779B1 + ids[1:]) & self.mask]
            last = first[1:][first[1:] > first[:-1]] - 1
            good[last] = False  # pairs don't reach into the next text
        else:
            good = known
        a, b, _ = runs(good, first)
        found = np.stack([a, b + more], axis=1)
        return found[found[:, 1] - found[:, 0] >= self.least]

    def match(self, ids: list[int], at: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (first, behind the last; merged) in a run that begins at ``at``, and the items with windows."""
        edges, link, long = self.steps()
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        window, items, short = self.window, self.items, self.short
        state = length = 0
        for c in ids:
            at += 1
            while (to := edges.get(state << 32 | c)) is None and state:
                state = link[state]
                length = long[state]
            if to is not None:
                state, length = to, length + 1
            reach = 0
            if length >= window:
                s = state
                while long[link[s]] >= window:
                    s = link[s]
                found |= items[s]
                reach = window
            for n, item in short.get(state, ()):
                if n <= length:
                    found.add(item)
                    reach = max(reach, n)
            if reach:
                begin = at - reach
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at))
        return spans, found

    def search(self, texts: pa.Array) -> Iterator[tuple]:
        """For some texts after the other: (bytes, bounds), the places of their words (starts, ends, first word of each
        text), and of the texts that are hit the spans of hit words and the names of the items."""
        for _, raw, bounds in slabs(texts):
            data, starts, ends, first = _places(raw, bounds)
            ids = self.table.numbers(data, starts, ends, add=False) + 1
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            found = self.candidates(ids, first) if len(ids) >= self.least else np.zeros((0, 2), np.int64)
            for (a, b), text in zip(found.tolist(), (np.searchsorted(first, found[:, 0], "right") - 1).tolist(), strict=True):
                begin = int(first[text])
                own, names = self.match(ids[a:b].tolist(), a - begin)
                if own:
                    spans.setdefault(text, []).extend(own)
                    items.setdefault(text, set()).update(self.names[x] for x in names)
            yield (raw, bounds), (starts, ends, first), spans, items


def _places(raw: bytes, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and the first word of each text (one more at the end)."""
    data = padded(raw.translate(_TABLE))
    return data, *runs(data[: len(raw)] != 32, np.array([0, len(raw)]) if bounds is None else bounds)


def _blocks(bench: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[tuple[int, list[tuple[str, list[bytes]]]]]:
    """The number of blocks and the items of each: about BLOCK characters at most, each read from its own buckets."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if total <= BLOCK else 2 * (total // BLOCK + 1)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield n, [x for row in part.collect() for x in _parts(row.name, words(row.text), window)]


def _parts(name: str, ws: list[bytes], window: int) -> Iterator[tuple[str, list[bytes]]]:
    """An item, or, if it is very long, parts of it that hold all its windows."""
    most = max(BLOCK // 8, 2 * window)
    for at in range(0, max(1, len(ws) - window + 1), most):
        yield name, ws[at : at + most + window - 1]


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, text, n_words, n_hit, items, spans`` for each row of ``docs``.

    Words are runs of letters A-Z (lower-cased), digits and non-ASCII characters. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A
    word in an occurrence of a window is hit; ``spans`` are the merged runs of hit words (first,
    behind the last) and ``items`` the sorted ids, as strings, of the items whose windows occur; a
    null item id is "null". Null and empty texts have no words. No items: nothing is hit. Items of
    one id count once; rows of one doc_id are handled apart. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    machine, given = _located(rows, "text", bench, window, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for (_, bounds), (_, _, first), spans, items in _search(machine, batch, 1, 2):
                n = len(bounds) - 1
                own = [spans.get(k, []) for k in range(n)]
                hit = [sum(b - a for a, b in x) for x in own]
                found = pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.string()))
                places = pa.array([[{"a": a, "b": b} for a, b in x] for x in own], _SPANS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(first), pa.int64()), pa.array(hit, pa.int64()), found, places], names=["doc_id", "text", "n_words", "n_hit", "items", "spans"])
                row += n
        trim_memory()

    return given.mapInArrow(run, FOUND)


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _located(docs: DataFrame, text_col: str, bench: DataFrame, window: int, item_id: str, item_text: str):
    """With one block of items, its automaton, broadcast, and ``docs``. With several, None, and ``docs`` with two more
    columns: the items and the spans that all blocks together find in the text, null where they find nothing."""
    text, hits = F.col(text_col).cast("string"), None
    for n, block in _blocks(bench, window, item_id, item_text):
        machine = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
        if n == 1:
            return machine, docs
        texts = docs.where(text.isNotNull()).select(text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))
        part = materialise(texts.mapInArrow(_hits(machine), "h bigint, h2 bigint, items array<string>, spans array<struct<a:int,b:int>>").dropDuplicates(["h", "h2"]), "hits")
        machine.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    names = [fresh(docs.columns, x) for x in ("hit_h", "hit_h2", "hit_items", "hit_spans")]
    per = hits.groupBy("h", "h2").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))  # a row for each block at most
    per = materialise(per.toDF(*names), "hits")
    few = per.count() <= MOST_BROADCAST
    found = docs.join(F.broadcast(per) if few else per, (F.xxhash64(text) == F.col(names[0])) & (F.xxhash64(F.lit(1), text) == F.col(names[1])), "left")
    return None, found.select(*[F.col(f"`{c}`") for c in docs.columns], *names[2:])


def _hits(machine):
    """Of texts with two hashes, those that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for (_, bounds), _, spans, items in machine.value.search(batch.column(0)):
                at = sorted(spans)
                hashes = [x.take(pa.array([row + k for k in at], pa.int64())) for x in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array([sorted(items[k]) for k in at], pa.list_(pa.string())), pa.array([[{"a": a, "b": b} for a, b in spans[k]] for k in at], _SPANS)], names=["h", "h2", "items", "spans"])
                row += len(bounds) - 1
        trim_memory()

    return run


def _search(machine, batch: pa.RecordBatch, at: int, more: int) -> Iterator[tuple]:
    """``Automaton.search`` of the texts in column ``at``; without an automaton, what columns ``more`` and after say."""
    if machine is not None:
        yield from machine.value.search(batch.column(at))
        return
    for row, raw, bounds in slabs(batch.column(at)):
        spans, items = {}, {}
        for k in range(len(bounds) - 1):
            if batch.column(more)[row + k].is_valid:
                items[k] = set(batch.column(more)[row + k].as_py())
                spans[k] = merged([(x["a"], x["b"]) for x in batch.column(more + 1)[row + k].as_py()])
        yield (raw, bounds), _places(raw, bounds)[1:], spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the words of ``spans`` and what stands between them."""
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : int(starts[a])])
        last = int(ends[b - 1])
    return b"".join([*out, raw[last:]])


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    _, starts, ends, _ = _places(text.encode())
    return _without(text.encode(), starts, ends, spans).decode()


def clean(docs: DataFrame, bench: DataFrame, window: int = 10, max_coverage: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, same columns, with hit spans cut out of the text; documents of which more than
    ``max_coverage`` of the words are hit go.

    Spans are those of ``find_contamination``. Null and empty texts and texts without hits stay as they
    are; rows are taken one by one, so rows that repeat an id or a text are treated alike. Without
    items nothing changes; an empty table stays empty.
    """
    machine, given = _located(docs, text_col, bench, window, item_id, item_text)
    at, more = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for (raw, bounds), (starts, ends, first), spans, _ in _search(machine, batch, at, more):
                n = len(bounds) - 1
                own = pa.RecordBatch.from_arrays([x.slice(row, n) for x in batch.columns[:more]], schema=pa.schema(list(batch.schema)[:more]))
                row += n
                if spans:
                    keep, changed, texts = np.ones(n, bool), np.zeros(n, bool), []
                    for k in sorted(spans):
                        keep[k] = sum(b - a for a, b in spans[k]) <= max_coverage * (first[k + 1] - first[k])
                        changed[k], begin = True, int(bounds[k])
                        words_at = slice(int(first[k]), int(first[k + 1]))
                        texts.append(_without(raw[begin : int(bounds[k + 1])], starts[words_at] - begin, ends[words_at] - begin, spans[k]).decode(errors="replace"))
                    column = pc.replace_with_mask(own.column(at), pa.array(changed), pa.array(texts, own.schema.field(at).type))
                    own = own.set_column(at, own.schema.field(at), column).filter(pa.array(keep))
                yield own
        trim_memory()

    return given.mapInArrow(run, docs.schema)


def items_digest(items):
    """SHA-256, in lowercase hex, of the sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
