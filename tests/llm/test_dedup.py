import collections
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.components import connected
from loam.llm.exact_dedup import exact_dedup
from loam.llm.line_dedup import line_dedup, passage_dedup
from loam.llm.ngram_jaccard import ngram_jaccard, shingle_sets, trie_links

WIDE = "doc_id bigint, text string, digest string, uid int, best string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None, "s") for r in rows], WIDE)


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, " \t"), (7, "c" * 200_000), (None, "ab"), (3, "a  b"), (8, "é"), (9, "é")]
    got = exact_dedup(docs(spark, rows), heavy=2).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    by = {k: sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in v) for k, v in groups.items()}
    ab = by[hashlib.sha256(b"ab").hexdigest()]
    assert len(ab) == 5 and {x[1] for x in ab} == {3} and {x[2] for x in ab} == {5} and sum(x[3] for x in ab) == 1
    assert by[hashlib.sha256(b"").hexdigest()] == [("4", 6, 3, False), ("5", 6, 3, False), ("6", 6, 3, True)]
    assert by[hashlib.sha256("é".encode()).hexdigest()] == [("8", 8, 2, True), ("9", 8, 2, False)]
    assert exact_dedup(docs(spark, []).limit(0)).count() == 0


def brute_lines(rows, run=3, long_words=50):
    """All windows of all documents, one after the other."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for size in range(1, run + 1):  # all windows of all documents; the shorter ones only with enough words
            for k in range(len(at) - size + 1):
                window = at[k : k + size]
                if size < run and sum(len(lines[j].split()) for j in window) < long_words:
                    continue
                key = tuple(lines[j].strip(" \t\x0b\x0c\r") for j in window)
                if key in seen:
                    gone.update(window)
                seen.add(key)
        out[doc_id] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " c ", "", "d", "e" * 9, "w " * 60, "v " * 30, "u " * 24]), max_size=12), min_size=1, max_size=6))
def test_line_dedup(spark, texts):
    rows = list(enumerate("\n".join(t) for t in texts))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(spark):
    passage = "one\ntwo\nthree\nfour"
    rows = [(5, passage), (None, f"x\n{passage}\ny"), (6, None), (7, ""), (8, passage), (8, passage)]
    got = [(r.doc_id, r.n_removed, r.text) for r in line_dedup(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(5, 0, passage), (None, 4, "x\ny"), (6, 0, ""), (7, 0, ""), (8, 4, ""), (8, 4, "")], key=repr)
    assert line_dedup(docs(spark, []).limit(0)).count() == 0


def test_line_dedup_runs(spark):
    """Runs longer than a window, a very common line, and passages of two lines of fewer than 50 words each."""
    random = np.random.default_rng(11)
    long = [f"line {i} of the run" for i in range(30)]
    two = [" ".join(f"a{i}" for i in range(28)), " ".join(f"b{i}" for i in range(27))]
    rows = []
    for i in range(60):
        own = [f"own {i} {j}" for j in range(int(random.integers(0, 4)))]
        at, n = int(random.integers(0, 25)), int(random.integers(0, 30))
        rows.append((i, "\n".join([*own, "common", *long[at : at + n], *(two if i % 4 == 0 else two[: i % 2]), "common", "common", *own[:1]])))
    wanted = brute_lines(rows)
    assert wanted[4][1] > 0 and sum(x[1] for x in wanted.values()) > 300
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(docs(spark, rows)).collect()} == wanted


@pytest.mark.parametrize("pair", [(50991, 387784), (202597, 252832)])
def test_line_dedup_tells_long_lines_apart(spark, pair):
    a, b = ("w " * 49 + f"n{x}" for x in pair)  # the 32-bit hashes of their 64-bit hashes are equal
    rows = [(1, a), (2, b), (3, f"{a}\n{b}")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows) == {1: (1, 0, a), 2: (1, 0, b), 3: (2, 2, "")}


def brute_passages(rows, words=51):
    """All windows of all documents, one after the other."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        own, gone = [x.strip(" \t\n\x0b\x0c\r") for x in pieces], set()
        for i in range(len(own) - words + 1):
            key = tuple(own[i : i + words])
            if key in seen:
                gone.update(range(i, i + words))
            seen.add(key)
        head = text[: len(text) - len("".join(pieces))]
        out[doc_id] = (len(pieces), len(gone), head + "".join(x for i, x in enumerate(pieces) if i not in gone))
    return out


def test_passages_repeat_across_lines_and_inside_them(spark):
    passage = [f"p{i}" for i in range(60)]
    one, two = " ".join(passage), " ".join(passage[:30]) + "\n" + " ".join(passage[30:])
    rows = [(1, f"start\n{two}\nend"), (2, f"other\n{two}\nlines"), (3, f"inside a longer {one} line"), (4, one), (5, " ".join(passage[:50])), (6, f" {' '.join(passage[5:56])}"), (7, ""), (8, one * 2)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in passage_dedup(docs(spark, [*rows, (4, one), (9, None)])).collect()}
    assert got.pop(9) == (0, 0, "") and got == brute_passages(rows)
    assert [got[k][1] for k in range(1, 8)] == [0, 60, 60, 60, 0, 51, 0] and got[3][2] == "inside a longer line"
    assert passage_dedup(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("words", [2, 5, 51])
def test_passage_dedup(spark, words):
    random = np.random.default_rng(words)
    base = [f"w{x}" for x in random.integers(0, 9 if words < 51 else 500, 400)]
    rows = []
    for i in range(40):
        at, n = random.integers(0, 300), random.integers(0, 4 * words)
        text = [f"u{x}" for x in random.integers(0, 99, 5)] + base[at : at + n] + ["x"] * int(random.integers(0, 2 * words))
        rows.append((i, " " * (i % 3) + "".join(x + ("\n", " ", "\t ")[int(random.integers(0, 3))] for x in text)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in passage_dedup(docs(spark, rows), words=words).collect()}
    assert got == brute_passages(rows, words) and any(x[1] for x in got.values())


def brute_components(rows, size=5, percent=75):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    low = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)].append(doc_id)
    return sorted((doc_id, len(sets[i]), min(low[find(i)])) for i, (doc_id, _) in enumerate(rows))


def family(seed, count, words=60, edits=4):
    random = np.random.default_rng(seed)
    base = [f"w{x}" for x in random.integers(0, 40, words)]
    out = []
    for _ in range(count):
        text = list(base)
        for at in random.integers(0, words, random.integers(0, edits)):
            text[at] = f"z{random.integers(0, 9)}"
        out.append(" ".join(text))
    return out


def shingles(text):
    return next(shingle_sets(pa.array([text]), 5))[0]


def test_shingle_sets(monkeypatch):
    import loam.llm.words as words

    random = np.random.default_rng(5)
    texts = [" ".join(random.choice(["a", "Bc", "é" * 13, "w" * 30, "\t", "\n\n", ""], random.integers(0, 40))) for _ in range(300)] + [None, "", "x " * 900]
    apart = [shingles(t).tolist() for t in texts]
    names = {}
    for text, found in zip(texts, apart, strict=True):
        w = (text or "").encode().lower().split()
        wanted = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(found) == len(wanted) and found == sorted(found)
        names.setdefault(tuple(sorted(wanted)), set()).add(tuple(found))
    assert all(len(x) == 1 for x in names.values()) and len({x for v in names.values() for x in v}) == len(names)
    for slab in (1, 100, 10_000):
        monkeypatch.setattr(words, "SLAB", slab)
        together = [v[a:b].tolist() for v, bounds in shingle_sets(pa.array(texts), 5) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert together == apart


def test_ngram_jaccard(spark):
    texts = [t for seed in range(5) for t in family(seed, 9)] + ["A b\tC", "a B c", "one two three four five", None, "", "  ", "x " * 3000, "x " * 3001]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r)[:3] for r in ngram_jaccard(docs(spark, rows)).collect())
    assert got == brute_components(rows)


def test_ngram_jaccard_split_blocks(spark, monkeypatch):
    import loam.llm.ngram_jaccard as module

    rows = [(i, t) for i, t in enumerate(family(3, 60, edits=7))]
    monkeypatch.setattr(module, "BLOCK", 8)
    assert sorted(tuple(r) for r in ngram_jaccard(docs(spark, rows)).collect()) == brute_components(rows)


def test_ngram_jaccard_very_long(spark):
    words = [f"w{i}" for i in range(600_004)]  # 600,000 shingles, 514,286 in common to link
    other, third = list(words), list(words)
    other[::100_000], third[::20] = [f"x{i}" for i in range(7)], [f"y{i}" for i in range(30_001)]
    rows = [(i, " ".join(t)) for i, t in enumerate([words, other, third, ["a", "b"]])]
    got = sorted(tuple(r)[:3] for r in ngram_jaccard(docs(spark, rows)).collect())
    assert got == [(0, 600_000, 0), (1, 600_000, 0), (2, 600_000, 2), (3, 1, 3)]


@pytest.mark.parametrize("held", [3, 10, 1000])
def test_groups_come_whole(monkeypatch, held):
    import loam.llm.ngram_jaccard as module

    monkeypatch.setattr(module, "HELD", held)
    cls = np.repeat([1, 2, 5, 6, 7, 9], [2, 40, 30, 1, 12, 3])
    table = pa.table({"cls": cls, "token": np.arange(len(cls))})
    for size in (1, 7, 42, 100):
        found = list(module._whole(iter(table.to_batches(size)), "cls"))
        assert np.concatenate([x["token"] for x in found]).tolist() == list(range(len(cls)))
        assert [c for x in found for c in np.unique(x["cls"]).tolist()] == [1, 2, 5, 6, 7, 9]


def test_ngram_jaccard_edges(spark):
    assert ngram_jaccard(docs(spark, []).limit(0)).count() == 0
    got = sorted((tuple(r) for r in ngram_jaccard(docs(spark, [(None, "a b"), (3, "a b"), (None, "q"), (4, None), (3, "a b")])).collect()), key=repr)
    assert got == sorted([(None, 1, 3), (3, 1, 3), (3, 1, 3), (None, 1, None), (4, 0, 4)], key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_trie_links(seed):
    rows = [(i, t) for i, t in enumerate(family(seed, 40, edits=9))]
    first = {}
    for i, t in rows:
        first.setdefault(shingles(t).tobytes(), i)
    own = sorted(first.values())
    sets = [shingles(rows[i][1]) for i in own]
    roots = trie_links(np.array(own), np.array([len(s) for s in sets]), sets, 75)
    assert roots.tolist() == [c for _, _, c in brute_components([rows[i] for i in own])]


def test_components(spark):
    random = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
