import itertools
import os
import pickle

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import lang_id, toxicity
from loam.llm.decontaminate import Automaton, clean, find_contamination, without_spans, words
from loam.llm.mixing import mix, source_targets
from loam.llm.ngram_jaccard import ngram_jaccard


def brute_hits(text, items, window):
    ws, hit, found = words(text), set(), set()
    for name, item in items:
        n = min(window, len(item))
        for k in range(len(item) - n + 1) if n else ():
            for at in range(len(ws) - n + 1):
                if ws[at : at + n] == item[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(name)
    return hit, found


@settings(deadline=None)
@given(st.lists(st.text("abc ", max_size=14), max_size=4), st.text("abcx ", max_size=40), st.integers(1, 4))
def test_automaton(texts, doc, window):
    items = [(str(i), words(" ".join(t))) for i, t in enumerate(texts)]
    machine = Automaton(items, window)
    doc = " ".join(doc)
    together = [doc, None, doc[::-1], "", doc]
    (_, bounds), _, spans, found = next(pickle.loads(pickle.dumps(machine)).search(pa.array(together)))
    assert len(bounds) == 6
    for k, text in enumerate(together):
        hit, names = brute_hits(text, items, window)
        assert {x for a, b in spans.get(k, ()) for x in range(a, b)} == hit and found.get(k, set()) == names
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(spans.get(k, ())))


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_contamination(spark, monkeypatch, block):
    import loam.llm.decontaminate as module

    monkeypatch.setattr(module, "BLOCK", block)
    long = " ".join(f"q{i}" for i in range(25))
    bench = spark.createDataFrame([(1, long, "x"), (2, "Short item", "x"), (3, None, "x"), (4, "!!", "x"), (None, "é ß", "x"), (12, long, "x")], "item_id bigint, text string, words string")
    rows = [(1, f"Before, {long.upper()}! after"), (2, " ".join(long.split()[:9])), (3, "a short, ITEM here"), (4, None), (5, ""), (6, "xé ß"), (7, "É ß é-ß"), (8, "z " * 100_000 + long)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, items int")
    items = [("1", words(long)), ("2", words("short item")), ("null", words("é ß")), ("12", words(long))]
    for r in find_contamination(docs, bench).collect():
        hit, found = brute_hits(r.text, items, 10) if r.doc_id != 8 else (set(range(25)), {"1", "12"})
        assert (r.n_words, r.n_hit, r["items"]) == (len(words(r.text)), len(hit), sorted(found)), r.doc_id
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in find_contamination(docs, bench.limit(0)).collect()} == {0}
    kept = {r.doc_id: r.text for r in clean(docs, bench, max_coverage=0.95).collect()}
    assert kept[1] == "Before, ! after" and kept[3] == "a , here".replace(" ,", " ") and kept[2] == rows[1][1] and kept[4] is None and kept[6] == "xé ß"
    assert 7 in kept and clean(docs, bench).columns == docs.columns


@pytest.mark.parametrize("most", [50_000, 0])
def test_many_blocks_write_hits_only(spark, monkeypatch, most):
    import loam.llm.decontaminate as module

    items = [" ".join(f"i{k}x{j}" for j in range(14)) for k in range(30)] + [" ".join(f"long{j}" for j in range(400))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [(i, " ".join(f"w{(7 * i + j) % 90}" for j in range(400)) + (f" {items[i][8:]} more" if i < 31 else "")) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1.5, "x") for i, t in rows], "doc_id bigint, text string, h double, hit_spans string")
    whole, wanted = clean(docs, bench, max_coverage=0.02).collect(), find_contamination(docs, bench).collect()
    monkeypatch.setattr(module, "BLOCK", 2000)
    monkeypatch.setattr(module, "MOST_BROADCAST", most)
    written, old = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: written.append(old(df, name)) or written[-1])
    assert sorted(map(repr, find_contamination(docs, bench).collect())) == sorted(map(repr, wanted)) and sum(r.n_hit > 0 for r in wanted) == 31
    assert len(written) > 5 and all("text" not in x.columns for x in written) and sum(len(r.items) + 2 * len(r.spans) for x in written[:-1] for r in x.collect()) < 300
    assert sorted(map(repr, clean(docs, bench, max_coverage=0.02).collect())) == sorted(map(repr, whole)) and len(whole) < 300


def test_bytes_that_are_no_text(spark):
    """Texts that aren't UTF-8, as files may hold them: their bytes are part of words."""
    docs = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF6220636420') AS string) || 'one two three' AS text")
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert find_contamination(docs, bench).select("n_words", "n_hit").first() == (5, 3)
    assert ngram_jaccard(docs).select("doc_id", "n_shingles", "component_id").first() == (1, 1, 1)
    assert lang_id.predict(docs, None).first().lang_pred == "und"


def test_spans_are_cut_out():
    assert without_spans("é, one-two three.", [(1, 3)]) == "é,  three."
    assert without_spans("a b", [(0, 2)]) == ""


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > repeats * sizes[s]] if free else []
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
            free.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    random = np.random.default_rng(seed)
    rows = [(i, " w" * int(random.integers(0, 30)), [None, "a", "b", "ä", "Z", "big"][min(5, int(random.integers(0, 9)))]) for i in range(3000)]
    rows += [(3001, None, "only null"), (None, "no id here", "a"), (3002, "", "a"), (5, "again", "a")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, source string, size int")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    targets = brute_targets(sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(targets[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - targets[s]) <= 20
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(tuple, mix(docs.repartition(7)).drop("source").collect()), key=repr) == sorted(map(tuple, mix(docs).drop("source").collect()), key=repr)
    # a larger share takes a superset
    less = {r.doc_id: r.copies for r in mix(docs, share=1.0, repeats=1).collect()}
    assert all(r.copies >= 0 for r in got) and set(less.values()) <= {0, 1}
    assert mix(docs.limit(0)).count() == 0


def test_targets_of_nothing(spark):
    df = spark.createDataFrame([("a", 0), (None, 0)], "source string, size bigint")
    assert {r.target for r in source_targets(df).collect()} == {0.0}


DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_language_of_small_texts(spark):
    en, de = "the cat and the dog were there with that thing", "der hund und die katze waren nicht auf dem dach"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "12 34 !!", "de", 1), (103, "the dog and that", None, 1), (104, "die katze " * 40_000, None, 1), (104, "die katze", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in lang_id.identify(docs).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (104, "de")} <= got
    assert all(0 <= r.score <= 1 for r in lang_id.identify(docs).collect())
    assert lang_id.identify(docs.limit(0)).count() == 0


@needs_data
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert np.mean([r.rejected for r in got]) < 0.01


def mixed(h, kind):
    wrap = (1 << 64) - 1
    h = (h ^ kind) * 0xBF58476D1CE4E5B9 & wrap
    return ((h ^ h >> 31) * 0x94D049BB133111EB & wrap) >> 40


def rolled(codes):
    h = 0
    for c in codes:
        h = (h * 0x9E3779B97F4A7C15 + c) & (1 << 64) - 1
    return h


def spread(codes):
    return sum(c * pow(0xD6E8FEB86659FD93, i, 1 << 64) for i, c in enumerate(codes)) & (1 << 64) - 1


ODD = ["the dog", None, "", " \t\n ", "12 34", "Ünïcode WÖRDER, der\u00a0hund", "a", "\n\nx.\n y!", "end. \"Said.\" more", "İi ﬁ ß", "long" * 9000, "the dog " * 3000]


def plain_language(model, text):
    """One word and one feature after the other."""
    total, n = np.zeros(len(model.langs)), 0
    for word in lang_id.LETTERS.findall((text or "").lower()):
        codes = [ord(c) for c in f"<{word}>"]
        for k in range(1, 5):
            for i in range(len(codes) - k + 1):
                total, n = total + model.table[mixed(rolled(codes[i : i + k]), k) % lang_id.BUCKETS], n + 1
        total, n = total + model.table[mixed(spread(codes), 0) % lang_id.BUCKETS], n + 1
    if not n:
        return "und", 0.0, True
    p = lang_id.softmax((total / n + model.bias) / model.temperature)
    return model.langs[int(p.argmax())], float(p.max()), bool(p.max() < model.floor)


@needs_data
def test_language_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").limit(60).select("doc_id", "text", "lang")
    model = lang_id.train(docs)
    model.floor = 0.9
    texts = [r.text for r in docs.collect()] + ODD
    given = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, score double")
    got = lang_id.predict(given, model).collect()
    wanted = {i: plain_language(model, t) for i, t in enumerate(texts)}
    assert len(got) == len(texts) and {r.lang_pred for r in got} > {"und"} and {r.rejected for r in got} == {True, False}
    for r in got:
        assert (r.lang_pred, r.rejected) == (wanted[r.doc_id][0], wanted[r.doc_id][2]) and r.score == pytest.approx(wanted[r.doc_id][1])
    kept = lang_id.keep_recognised(given, model).collect()
    assert {r.doc_id for r in kept} == {k for k, v in wanted.items() if not v[2]} and kept[0].score == 1.0


def test_samples_are_fixed_and_copies_count_once(spark):
    rows = [(i, f"the cat number {i} sat", "en") for i in range(300)] + [(1000 + i, "der hund", "de") for i in range(500)] + [(2000 + i, f"die katze {i}", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one, two = lang_id.labelled_sample(docs, 100), lang_id.labelled_sample(docs.repartition(7), 100)
    assert one == two and one[0].count("der hund") <= 1 and 30 < one[1].count("de") < 80
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id bigint, toxic int")
    assert toxicity.labelled_sample(docs, labels, 100) == toxicity.labelled_sample(docs.repartition(5), labels.repartition(3), 100)


def plain_toxicity(model, text):
    """One sentence, word and feature after the other."""
    pieces = [x for x in (text or "").replace("\n", " \n ").split(" ") if x]
    z, at = [], 0
    for i, piece in enumerate(pieces):
        if i == 0 or pieces[i - 1].rstrip("\"')]»”’").endswith(toxicity.ENDS):
            z.append(model.bias)
        for w in toxicity.LETTERS.findall(piece.lower()):
            codes = [ord(c) for c in w]
            found = {mixed(spread(codes), 0)} | {mixed(rolled(codes[:k]), k) for k in range(3, 7) if len(w) > k} | {mixed(rolled(codes[i : i + 4]), 8) for i in range(len(w) - 3)}
            z[-1] += sum(float(model.weights[f]) for f in {f % toxicity.BUCKETS for f in found})
    odds = toxicity.log_odds(np.array(z or [model.bias]))
    return 1 / (1 + np.exp(-np.clip(odds - model.cut, -500, 500)))


@needs_data
def test_toxicity_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").limit(60)
    weights = np.random.default_rng(3).normal(0, 0.3, toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(weights, -3.0, 0.4)
    texts = [r.text for r in docs.collect()] + ODD
    got = toxicity.score(spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, score double"), model).collect()
    assert len(got) == len(texts) and {r.predicted for r in got} == {0, 1}
    for r in got:
        assert r.score == pytest.approx(plain_toxicity(model, texts[r.doc_id]), rel=1e-6, abs=1e-12) and r.predicted == int(r.score >= 0.5)


def test_noisy_or():
    z = np.array([-1.0, 0.5, -3.0])
    p = 1 - np.prod(1 - 1 / (1 + np.exp(-z)))
    assert toxicity.log_odds(z) == pytest.approx(np.log(p / (1 - p)))
    assert np.isfinite(toxicity.log_odds(np.array([-800.0]))) or toxicity.log_odds(np.array([-800.0])) < -100


def test_toxic_sentences_are_found(spark):
    random = np.random.default_rng(0)
    bad = ["scum", "moron", "trash"]

    def text(toxic):
        s = [" ".join(f"word{x}" for x in random.integers(0, 200, 8)) + "." for _ in range(8)]
        if toxic:
            s[3] = f"you are {bad[int(random.integers(0, 3))]} really."
        return " ".join(s)

    rows = [(i, text(i % 3 == 0), 1) for i in range(400)] + [(900, None, 1), (901, "", 1), (902, "a " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(400)] + [(None, 1, "x"), (5, None, "x"), (0, 1, "x")], "doc_id bigint, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    found = [r for r in held if r.predicted]
    assert np.mean([any(b in r.sentences[0].text for b in bad) and r.sentences[0].n == 3 for r in found]) > 0.95
    assert {got[k].predicted for k in (900, 901, 902)} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_all_toxic_sentences_are_found(spark):
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    weights[toxicity.features(["scum"])[0]] = 2.0
    texts = [" ".join("You scum." if k % 3 == 0 else "Good day." for k in range(n)) for n in (3, 30, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in toxicity.score(docs, toxicity.Model(weights, -1.0)).collect():
        n = texts[r.doc_id].count(".")
        assert r.predicted == 1 and [(x.n, x.text) for x in r.sentences] == [(k, "You scum.") for k in range(0, n, 3)]
