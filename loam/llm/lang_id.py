"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word gives its character n-grams (1 to 4, with marks at its ends) and itself as features, hashed
to a fixed number of buckets. A document is the mean of its features' embeddings; a linear layer
and a softmax follow. Both are trained by stochastic gradient descent in numpy, on a bounded sample
of labelled rows. Part of the sample is held back to calibrate: a temperature makes the scores
probabilities, and a threshold rejects what scores lower than nearly all correct answers.

As the model is linear in the mean, a word's share of the logits is a constant: it is computed once
for each distinct word that a task remembers, and the words of whole batches are looked up together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, trim_memory
from .words import Table, byte_table, padded, runs, slabs

BUCKETS = 1 << 16
LETTERS = re.compile(r"[^\W\d_]+")
PREDICTED = "lang_pred string, score double, rejected boolean"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams (1 to 4 characters, with marks at the ends) of lower-case words and of the
    words themselves, and for each the number of its word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(starts + size, size) - np.arange(len(codes))  # characters from here to the word's end
    grams, buckets, owners = np.zeros(len(codes), np.uint64), [], []
    for k in range(1, 5):
        grams[: len(codes) - k + 1] = grams[: len(codes) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :]
        whole = left >= k
        buckets.append(_bucket(grams[whole], k))
        owners.append(owner[whole])
    place = np.uint64(0xD6E8FEB86659FD93) ** (np.arange(len(codes)) - np.repeat(starts, size)).astype(np.uint64)
    buckets.append(_bucket(np.add.reduceat(codes * place, starts), 0))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """``table``: each bucket's share of the logits; ``floor``: the score below which a text is rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean + self.bias) / self.temperature


class Words:
    """Words as they stand between spaces, with their share of the logits and their number of features."""

    TABLE = byte_table(SPACES.encode())

    def __init__(self, model: Model, limit: int = 400_000) -> None:
        self.model, self.limit = model, limit
        self.forget()

    def forget(self) -> None:
        self.table, self.values = Table(self._learn), np.zeros((1024, len(self.model.langs) + 1))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw, parts, of = data.tobytes(), [], []
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            found = LETTERS.findall(raw[a:b].decode(errors="replace").lower())
            parts += found
            of += [k] * len(found)
        count = self.table.count
        while count + len(starts) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        new = self.values[count : count + len(starts)]
        of = np.array(of, np.int64)
        for begin in range(0, len(parts), 20_000):  # some 50 features a word
            ids, owner = features(parts[begin : begin + 20_000])
            word = of[begin + owner]
            order = np.argsort(word, kind="stable")
            ids, word = ids[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            new[word[first], :-1] += np.add.reduceat(self.model.table[ids], first, axis=0)
            new[word[first], -1] += np.diff(np.append(first, len(word)))

    def means(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For some texts after the other, the mean share of the logits over all features; NaN without letters."""
        for _, raw, bounds in slabs(texts):
            data = padded(raw.translate(self.TABLE))
            starts, ends, first = runs(data[: len(raw)] != 32, bounds)
            if self.table.count > self.limit:
                self.forget()
            numbers = self.table.numbers(data, starts, ends)
            total = np.zeros((len(bounds) - 1, self.values.shape[1]))
            some = np.flatnonzero(np.diff(first))
            if len(some):
                total[some] = np.add.reduceat(self.values[numbers], first[some], axis=0)
            yield np.divide(total[:, :-1], total[:, -1:], out=np.full((len(total), total.shape[1] - 1), np.nan), where=total[:, -1:] > 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], width: int = 16, epochs: int = 4, rate: float = 2.0, held_back: int = 5, kept: float = 0.999, seed: int = 7) -> Model | None:
    """Trains on texts with their languages; every ``held_back``-th one calibrates. None without letters.

    ``kept``: share of the correctly answered calibration texts that must score above the floor,
    which lies half-way below the lowest of them.
    """
    names = sorted(set(langs))
    rows = []
    for text, lang in zip(texts, langs, strict=True):
        found = features(LETTERS.findall((text or "").lower()))[0]
        if len(found):
            ids, counts = np.unique(found, return_counts=True)
            rows.append((ids, counts / counts.sum(), names.index(lang)))
    if not rows:
        return None
    train = [r for i, r in enumerate(rows) if i % held_back or len(rows) < 2 * held_back]
    check = [r for i, r in enumerate(rows) if not i % held_back or len(rows) < 2 * held_back]
    random = np.random.default_rng(seed)
    table, out, bias = random.normal(0, 0.3, (BUCKETS, width)), random.normal(0, 0.3, (width, len(names))), np.zeros(len(names))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in random.permutation(len(train)):
            ids, share, y = train[i]
            lr = rate * (1 - done / steps)
            hidden = share @ table[ids]
            g = softmax(hidden @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= lr * np.outer(hidden, g)
            bias -= lr * 0.1 * g
            table[ids] -= (lr * share / max(share.max(), 1e-9))[:, None] * back
            done += 1
    model = Model(names, table @ out, bias)
    means = np.array([share @ model.table[ids] for ids, share, _ in check])
    answers = np.array([y for _, _, y in check])
    losses = {}
    for t in np.geomspace(0.05, 20, 60):
        p = softmax((means + bias) / t)
        losses[t] = -np.log(np.maximum(p[np.arange(len(answers)), answers], 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    p = softmax(model.logits(means))
    right = p.max(axis=1)[p.argmax(axis=1) == answers]
    model.floor = float(np.quantile(right, 1 - kept)) / 2 if len(right) else 0.0
    return model


def labelled_sample(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = 20_000) -> tuple[list[str], list[str]]:
    """At most 2 x ``rows`` whole texts with their languages, about the same number of each where there are
    enough: the first by a hash of the text. Rows that repeat a text and its language count once, so the
    sample is the same on each run; texts over ``longest`` characters aren't chosen."""
    good = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= longest))
    counts = {x.lang: x["count"] for x in good.select("lang", "h").distinct().groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return [], []
    each = max(1, rows // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(each / n)).otherwise(share)
    spot = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = good.where(spot < share).dropDuplicates(["h", "lang"]).orderBy(spot, "h", "lang").limit(2 * rows).collect()
    got.sort(key=lambda x: (zlib.crc32(x.text.encode()), x.text, x.lang))
    return [x.text for x in got], [x.lang for x in got]


def train(docs: DataFrame, rows: int = 3000, **columns) -> Model | None:
    """A model from a bounded sample of ``docs``: ``rows`` is the bound."""
    return fit(*labelled_sample(docs, rows, **columns))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``lang_pred, score, rejected`` for each row, from the text alone.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if
    there was nothing to learn from (no model). Ties go to the first language by name. Other
    columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = sent.value, None
        words = Words(model) if model else None
        for batch in batches:
            row, texts = 0, batch.column(batch.num_columns - 1)
            for means in words.means(texts) if words else [np.full((len(texts), 1), np.nan)]:
                n, sure = len(means), ~np.isnan(means[:, 0])
                lang, score, rejected = np.full(n, -1), np.zeros(n), np.ones(n, bool)
                if sure.any():
                    p = softmax(model.logits(means[sure]))
                    lang[sure], score[sure], rejected[sure] = p.argmax(axis=1), p.max(axis=1), p.max(axis=1) < model.floor
                names = pa.array([*(model.langs if model else []), "und"], pa.string())
                found = names.take(pa.array(np.where(lang < 0, len(names) - 1, lang)))
                yield pa.RecordBatch.from_arrays([*[x.slice(row, n) for x in batch.columns[:-1]], found, pa.array(score), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])
                row += n
        words = None
        trim_memory()

    rows = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(list(keep), "text")))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{types}, {PREDICTED}" if types else PREDICTED)


def keep_recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``predict`` doesn't reject. Null texts and
    texts without letters go; rows that repeat are decided alike; an empty table stays empty."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words = Words(model)
        for batch in batches:
            row = 0
            for means in words.means(batch.column(at)):
                best = softmax(model.logits(np.nan_to_num(means))).max(axis=1)
                yield batch.slice(row, len(means)).filter(pa.array(~np.isnan(means[:, 0]) & (best >= model.floor)))
                row += len(means)
        words = None
        trim_memory()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, rows: int = 3000, held_out_of: int = 4, held_out: int = 2) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod ``held_out_of`` isn't ``held_out``; predicts all rows.

    ``doc_id, held_out, lang_pred, score, rejected``, one row per input row; a null doc_id is not learned
    from and not held out. Texts are taken as by ``predict``; rows that repeat get the same answer. An
    empty table gives no rows; other columns are ignored.
    """
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held_out_of)) == held_out
    model = train(docs.where(~out), rows)
    return predict(docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
