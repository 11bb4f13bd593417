"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence's score is a logistic
function of the summed weights of its words; a word's weight is that of its hashed features (the
word, its beginnings and its character 4-grams). Sentences end with certain signs before a space, and
with lines. A document is toxic if any sentence is: its score is the noisy-or of its sentences' scores. The weights are trained from document labels through the
noisy-or; afterwards the sentence scores say where the offence stands.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, trim_memory
from .words import Table, padded, slabs

BUCKETS = 1 << 18
LETTERS = re.compile(r"[^\W_]+")
ENDS = (".", "!", "?", "…", "。", "！", "？", "\n")
SCORED = "score double, predicted int, sentences array<struct<n:int,score:double,text:string>>"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each lower-case word (itself, its beginnings of 3 to 6 letters, its 4-grams), and for
    each bucket the number of its word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(starts + size, size) - np.arange(len(codes))  # letters from here to the word's end
    grams, kinds = np.zeros(len(codes), np.uint64), []
    for k in range(1, 7):
        full = max(0, len(codes) - k + 1)
        grams[:full] = grams[:full] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :]
        if k >= 3:
            longer = np.flatnonzero(size > k)
            kinds.append((_bucket(grams[starts[longer]], k), longer))
        if k == 4:
            whole = left >= 4
            kinds.append((_bucket(grams[whole], 8), owner[whole]))
    place = np.uint64(0xD6E8FEB86659FD93) ** (np.arange(len(codes)) - np.repeat(starts, size)).astype(np.uint64)
    kinds.append((_bucket(np.add.reduceat(codes * place, starts), 0), np.arange(len(words))))
    both = np.unique(np.concatenate([of * BUCKETS + f for f, of in kinds]))
    return both % BUCKETS, both // BUCKETS


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def pieces(data: np.ndarray, n: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of what stands between spaces, line ends being pieces of their own, and the first piece of
    each text (one more at the end)."""
    space, line = data[:n] == 32, data[:n] == 10
    starts = ~space
    starts[1:] &= space[:-1] | line[:-1] | line[1:]
    inner = bounds[:-1][bounds[:-1] < n]
    starts[inner] = ~space[inner]
    edge = space | starts
    edge[inner] = True
    at, edges = np.flatnonzero(starts), np.append(np.flatnonzero(edge), n)
    return at, edges[np.searchsorted(edges, at, "right")], np.searchsorted(at, bounds)


def ends_sentence(piece: str) -> bool:
    return piece.rstrip("\"')]»”’").endswith(ENDS)


def sentences(first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First pieces of the sentences of all texts, and the first sentence of each text (one more at the end), from
    the first piece of each text and whether a sentence ends with a piece."""
    starts = np.ones(len(ends), bool)
    starts[1:] = ends[:-1]
    starts[first[:-1][first[:-1] < len(ends)]] = True
    at = np.flatnonzero(starts)
    return at, np.searchsorted(at, first)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Log odds of a document's noisy-or at which it counts as toxic.
    cut: float = 0.0


class Words:
    """Pieces of texts, with the summed weights of their words and whether sentences end with them."""

    def __init__(self, value: Callable[[list[str]], np.ndarray] | None, limit: int = 400_000) -> None:
        self.value, self.limit = value, limit
        self.forget()

    def forget(self) -> None:
        self.table, self.values, self.ends, self.names = Table(self._learn), np.zeros(0), np.zeros(0, bool), []

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        new = [raw[a:b].decode(errors="replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.ends = np.concatenate([self.ends, np.fromiter(map(ends_sentence, new), bool, len(new))])
        if self.value is None:
            self.names += new
        else:
            self.values = np.concatenate([self.values, self.value(new)])

    def split(self, texts: pa.Array) -> Iterator[tuple]:
        """For some texts after the other: their bytes, the places and numbers of their pieces, and the first
        piece of each text."""
        for _, raw, bounds in slabs(texts):
            data = padded(raw)
            starts, ends, first = pieces(data, len(raw), bounds)
            if self.value is not None and self.table.count > self.limit:
                self.forget()
            yield raw, starts, ends, self.table.numbers(data, starts, ends), first


def words_of(found: list[str]) -> tuple[list[str], np.ndarray]:
    """The lower-case words in some pieces, and for each the number of its piece."""
    parts = [LETTERS.findall(x.lower()) for x in found]
    return [w for x in parts for w in x], np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def weigh(weights: np.ndarray) -> Callable[[list[str]], np.ndarray]:
    """A function from pieces to the summed weights of their words."""

    def value(found: list[str]) -> np.ndarray:
        out = np.zeros(len(found))
        for begin in range(0, len(found), 20_000):
            words, of = words_of(found[begin : begin + 20_000])
            bucket, owner = features(words)
            if len(bucket):
                out[begin : begin + 20_000] += np.bincount(of[owner], weights[bucket], len(found[begin : begin + 20_000]))
        return out

    return value


def log_odds(z: np.ndarray) -> float:
    """Log odds of the noisy-or of logistic scores with arguments ``z``."""
    none = -np.logaddexp(0, z).sum()  # log of the chance that no sentence is toxic
    return float(np.log(-np.expm1(min(none, -1e-300))) - none)


def fit(texts: list[str], labels: list[int], epochs: int = 80, rate: float = 0.1, decay: float = 1e-4, held_back: int = 5, significance: float = 4.0) -> Model | None:
    """Trains on whole texts with labels 0 or 1. None if a label is missing.

    Only features that stand in more toxic than other documents, by ``significance`` standard
    errors, get weights. Every ``held_back``-th text sets the cut, all do if too few of these are toxic.
    """
    if len(set(labels)) < 2:
        return None
    vocabulary, t, s, document, tokens, n = Words(None), [], [], [], [], 0
    for _, _, _, numbers, first in vocabulary.split(pa.array(texts, pa.large_string())):
        at, of = sentences(first, vocabulary.ends[numbers])
        numbers = numbers.astype(np.int32)
        t.append(numbers)
        s.append((n + np.repeat(np.arange(len(at)), np.diff(np.append(at, len(numbers))))).astype(np.int32))
        document.append((len(tokens) + np.repeat(np.arange(len(first) - 1), np.diff(of))).astype(np.int32))
        tokens += [numbers[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        n += len(at)
    lists, owners, buckets = vocabulary.names, [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for begin in range(0, len(lists), 20_000):  # some 25 features a word
        words, of = words_of(lists[begin : begin + 20_000])
        own, word = features(words)
        owners.append((begin + of[word]).astype(np.int32))  # the piece; sorted, as words are
        buckets.append(own.astype(np.int32))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    del owners, buckets, vocabulary
    trim_memory()
    starts = np.searchsorted(owner, np.arange(len(lists) + 1))
    seen, toxic, total = np.zeros((2, BUCKETS)), np.array(labels) == 1, len(labels)
    for d, words in enumerate(tokens):
        own = np.unique(words)
        held = np.concatenate([bucket[starts[w] : starts[w + 1]] for w in own.tolist()] or [bucket[:0]])
        seen[int(toxic[d]), np.unique(held)] += 1
    rates, both = (seen + 0.5) / (np.array([(~toxic).sum(), toxic.sum()])[:, None] + 1), (seen.sum(axis=0) + 1) / (total + 2)
    strong = (rates[1] - rates[0]) / np.sqrt(both * (1 - both) * (1 / toxic.sum() + 1 / (~toxic).sum())) >= significance
    owner, bucket = owner[strong[bucket]], bucket[strong[bucket]]
    t, s, doc, y = np.concatenate(t), np.concatenate(s), np.concatenate(document), np.array(labels)
    used = (np.arange(len(y)) % held_back != 0) | (len(y) < 4 * held_back)
    positive = y == 1
    balance = np.where(positive, 0.5 / max(1, (positive & used).sum()), 0.5 / max(1, (~positive & used).sum())) * used * used.sum()
    weights, bias = np.zeros(BUCKETS), -4.0
    square, mean = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, epochs + 1):
        value = np.bincount(owner, weights[bucket], len(lists))
        z = bias + np.bincount(s, value[t], n)
        score = 1 / (1 + np.exp(-np.maximum(z, -500)))
        none = np.bincount(doc, -np.logaddexp(0, z), len(y))
        odds = np.where(positive, np.exp(none) / np.maximum(-np.expm1(none), 1e-9), -1.0)  # of the loss, over the sentence's score
        g = -(odds * balance)[doc] * score
        by_word = np.bincount(t, g[s], len(lists))
        grad = np.append(np.bincount(bucket, by_word[owner], BUCKETS), g.sum()) / used.sum()
        grad[:-1] += decay * weights
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    value = np.bincount(owner, weights[bucket], len(lists))
    z = bias + np.bincount(s, value[t], n)
    none = np.minimum(np.bincount(doc, -np.logaddexp(0, z), len(y)), -1e-300)
    odds = np.log(-np.expm1(none)) - none
    check = ~used if (positive & ~used).sum() >= 30 else np.ones(len(y), bool)
    return Model(weights.astype(np.float32), float(bias), best_cut(odds[check], y[check]))


def best_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors, each class weighing the same."""
    order = np.argsort(odds)
    o, t = odds[order], y[order]
    missed = np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())
    false = ((1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)])) / max(1, (1 - t).sum())
    edges = np.concatenate([[o[0] - 2], o, [o[-1] + 2]])
    errors = missed + false
    gaps = np.where(errors <= errors.min() + 1e-12, edges[1:] - edges[:-1], -1)
    k = int(gaps.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, longest: int = 50_000) -> tuple[list[str], list[int]]:
    """At most about ``rows`` whole texts with labels, up to half of them toxic, chosen by a hash of
    the id. The chosen ids, at most 2 x ``rows``, are broadcast to the documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {x.toxic: x["count"] for x in known.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    toxic = min(counts.get(1, 0), rows // 2)
    share = F.when(F.col("toxic") == 1, F.lit(toxic / max(1, counts.get(1, 0)))).when(F.col("toxic") == 0, F.lit((rows - toxic) / max(1, counts.get(0, 0)))).otherwise(F.lit(0.0))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(spot < share).orderBy(spot, "doc_id").limit(2 * rows)
    got = docs.select("doc_id", "text").where(F.char_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    got = got.orderBy(spot, "doc_id", F.xxhash64("text"), "text").limit(4 * rows).select("text", "toxic").collect()
    got.sort(key=lambda x: (zlib.crc32(x.text.encode()), x.text, x.toxic))
    return [x.text for x in got], [x.toxic for x in got]


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score, predicted, sentences`` for each row, from the whole text alone.

    ``sentences`` (number, score, text) are all the offending ones of a document predicted toxic, the
    worst first. Null and empty texts are one empty sentence. With no model (nothing
    to learn from) all scores are 0. Other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    kinds = pa.list_(pa.struct([("n", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words = Words(weigh(model.weights)) if model else None
        for batch in batches:
            row, texts = 0, batch.column(batch.num_columns - 1)
            for raw, starts, ends, numbers, first in words.split(texts) if words else ():
                n = len(first) - 1
                at, of = sentences(first, words.ends[numbers])
                z = model.bias + np.add.reduceat(words.values[numbers], at) if len(at) else np.zeros(0)
                none = np.full(n, -np.logaddexp(0, model.bias))  # log of the chance that no sentence is toxic; of an empty text, it is one
                some = np.flatnonzero(np.diff(of))
                if len(some):
                    none[some] = np.add.reduceat(-np.logaddexp(0, z), of[some])
                none = np.minimum(none, -1e-300)
                chance = 1 / (1 + np.exp(-np.clip(np.log(-np.expm1(none)) - none - model.cut, -500, 500)))
                worst: list[list[dict]] = [[] for _ in range(n)]
                for k in np.flatnonzero(chance >= 0.5).tolist():
                    own = z[of[k] : of[k + 1]]
                    least, order = min(0.0, float(own.max())) if len(own) else 0.0, np.argsort(-own, kind="stable")
                    for i in order[own[order] >= least].tolist():
                        a = int(at[of[k] + i])
                        b = int(at[of[k] + i + 1]) if i + 1 < len(own) else int(first[k + 1])
                        said = raw[int(starts[a]) : int(ends[b - 1])].decode(errors="replace").strip()
                        worst[k].append({"n": i, "score": float(1 / (1 + np.exp(-own[i]))), "text": said})
                yield pa.RecordBatch.from_arrays([*[x.slice(row, n) for x in batch.columns[:-1]], pa.array(chance), pa.array((chance >= 0.5).astype(np.int32)), pa.array(worst, kinds)], names=[*keep, "score", "predicted", "sentences"])
                row += n
            if not words:
                n = len(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32)), pa.array([[]] * n, kinds)], names=[*keep, "score", "predicted", "sentences"])
        words = None
        trim_memory()

    rows = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(list(keep), "text")))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{types}, {SCORED}" if types else SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 5000, held_out_of: int = 5, held_out: int = 0) -> DataFrame:
    """Learns from labels of rows whose crc32(doc_id) mod ``held_out_of`` isn't ``held_out``; scores all rows.

    ``doc_id, held_out, score, predicted, sentences``, one row per input row; ``rows`` bounds the training
    sample. Labels are joined by doc_id, the greatest of several; rows without an id are not learned from
    and not held out. Texts are taken as by ``score``; rows that repeat get the same answer. An empty
    table gives no rows; other columns are ignored.
    """
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held_out_of)) == held_out
    model = fit(*labelled_sample(docs, labels.where(~out), rows))
    return score(docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
