"""The pipeline against a plain version of the same decisions, and its stages one by one."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from loam.llm import lang_id, ngram_jaccard
from loam.llm.decontaminate import words
from tests.llm.test_dedup import brute_components, family
from tests.llm.test_text import brute_hits, brute_targets

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random = np.random.default_rng(5)
    vocabulary = {"en": ["the", "cat", "and", "dog", "with", "house", "thing", "that"], "de": ["der", "hund", "und", "nicht", "haus", "auf", "einem", "schön"]}
    passage = " ".join(f"exam{i}" for i in range(20))
    texts = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = " ".join(f"{random.choice(vocabulary[lang])}{random.integers(0, 30) if random.random() < 0.5 else ''}" for _ in range(int(random.integers(3, 60))))
        texts.append((f"{text} {passage}, {text[::-1]}" if i % 10 == 0 else text, lang))
    texts += [(t, "en") for t in family(2, 12)] + [("12 34", "en"), (None, "de"), ("", None), (passage, "en"), ("the cat " * 5000, "en")]
    rows = [(i, t, lang, [None, "b", "a", "hot", "hot"][i % 5], len(t or "")) for i, (t, lang) in enumerate(texts)]
    path = f"{tmp_path_factory.mktemp('pipe')}"
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, [("1", words(passage))]


def plain(spark, path, rows, items):
    from tokenizers import Tokenizer

    model = lang_id.train(spark.read.parquet(f"{path}/documents.parquet"))

    def known(text):
        found = lang_id.features(lang_id.LETTERS.findall((text or "").lower()))[0]
        return len(found) > 0 and lang_id.softmax(model.logits(model.table[found].mean(axis=0))).max() >= model.floor

    kept = [r for r in rows if known(r[1])]
    smallest = {doc_id for doc_id, _, low in brute_components([r[:2] for r in kept]) if doc_id == low}
    cleaned = []
    for doc_id, text, _, source, _ in kept:
        if doc_id not in smallest:
            continue
        hit, _ = brute_hits(text, items, 10)
        if len(hit) > 0.8 * len(words(text)):
            continue
        if hit:
            data, low = text.encode(), text.encode().lower()
            spans, at = [], 0
            for w in words(text):
                at = low.index(w, at)
                spans.append((at, at + len(w)))
                at += len(w)
            runs = [k for k in sorted(hit) if k - 1 not in hit], [k for k in sorted(hit) if k + 1 not in hit]
            for a, b in reversed(list(zip(*runs, strict=True))):
                data = data[: spans[a][0]] + data[spans[b][1] :]
            text = data.decode()
        cleaned.append((doc_id, text, source))
    sizes = {}
    for _, text, source in cleaned:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    out, library = [], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for source, target in brute_targets(sizes).items():
        base = int(target // sizes[source]) if sizes[source] else 0
        budget, total = target - base * sizes[source], 0
        for _, doc_id, text in sorted((hashlib.md5(str(d).encode()).hexdigest()[:9], d, t) for d, t, s in cleaned if s == source):
            size = len(text.split())
            more = budget > 0 and total < budget and (total + size < budget or total + size - budget < budget - total)
            total = total + size if total < budget else total
            ids = [*library.encode(text, add_special_tokens=False).ids, 2]
            out += [(doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] * (base + more)
    return sorted(out)


def test_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder[0]).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == plain(spark, *folder)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert len(got) > 50


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "a b c", "en", None, 5), (7, "a b c", "en", None, 5)], COLUMNS)
    wide = docs.limit(9).selectExpr("*", "1 AS size", "2 AS score", "'x' AS rejected", "3 AS copies", "4 AS cls", "5 AS target", "6 AS component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0), odd, wide):
            out = stage(spark, given, folder[0])
            assert out.schema.simpleString() == given.schema.simpleString(), name
            assert out.count() <= 2 * given.count()
    assert corpus_pipeline.drop_near_copies(spark, odd, folder[0]).count() == 2
    clash = docs.limit(9).selectExpr("*", "1 AS __copy", "2 AS copy", "3 AS Row", "4 AS row_", "5 AS keep_row")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, folder[0]).schema.simpleString() == clash.schema.simpleString(), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "decontamination", "mixing", "token_output"]


def test_near_copies_go_by_row(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (9, ""), (9, ""), (None, None)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, a), (5, b), (None, c), (9, ""), (9, ""), (None, None)], key=repr)


@pytest.mark.parametrize("module", ["ngram_jaccard", "pipeline"])
def test_many_ids_are_joined_instead_of_sent(spark, folder, monkeypatch, module):
    monkeypatch.setattr(ngram_jaccard if module == "ngram_jaccard" else corpus_pipeline, "MOST_BROADCAST", 0)
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    smallest = {doc_id for doc_id, _, low in brute_components([r[:2] for r in folder[1]]) if doc_id == low}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, folder[0]).collect()} == smallest
