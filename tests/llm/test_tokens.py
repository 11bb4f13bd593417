import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.chat_format import chat_format, escape, format_chats, intersect, render, turns, unescape
from loam.llm.encoding import Encoder
from loam.llm.token_counts import allocate, count_tokens
from loam.llm.token_store import crc_moved, cuts, merkle_root, read_documents, token_store, verify, write_store

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = st.lists(st.sampled_from(["a", "Bc", "'s", "'", "don't", " ", "  ", "\n", "é", "1", "²", "½", "_", ".", "\t", "\xa0", "\x85", "\x1c", "👍", "字", "<|endoftext|>", "<|im_end|>", "\0", "\r\n"]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def library():
    return Encoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=30)))
def test_pieces_give_the_library_ids(library, text):
    wanted = library.library.encode(text, add_special_tokens=False)
    assert np.frombuffer(library.ids(text), "<u4").tolist() == wanted.ids
    ids, spans = library.spans(text)
    assert ids.tolist() == wanted.ids and spans.tolist() == [list(x) for x in wanted.offsets]


def test_full_memory_changes_nothing():
    small, texts = Encoder(PATH, limit=3), ["the cat sat on the mat", "a dog, a cat", "the mat"] * 3
    big = Encoder(PATH)
    assert [small.ids(t) for t in texts] == [big.ids(t) for t in texts]


def cuts1(ids):
    return cuts(ids, np.array([0, len(ids)]))[0]


def test_cuts_follow_content():
    random = np.random.default_rng(0)
    shared = random.integers(0, 50_000, 20_000).astype("<u4")
    a, b = np.concatenate([random.integers(0, 50_000, 777).astype("<u4"), shared]), np.concatenate([random.integers(0, 50_000, 1234).astype("<u4"), shared])
    chunks = [{x[i:j].tobytes() for i, j in zip([0, *cuts1(x)[:-1]], cuts1(x), strict=True)} for x in (a, b)]
    assert len(chunks[0] & chunks[1]) > 0.7 * len(chunks[0])
    for n in (0, 1, 255, 257, 5000):
        assert cuts1(shared[:n])[-1] == n
    assert max(np.diff([0, *cuts1(np.zeros(9000, "<u4"))])) <= 4096


def test_crc_parts():
    a, b = b"hello world", b"0123456789ab"
    moved = crc_moved(np.array([zlib.crc32(a), zlib.crc32(b)], np.int64), np.array([len(b), 0]))
    assert int(moved[0] ^ moved[1]) == zlib.crc32(a + b)
    assert merkle_root([b"a"]) != merkle_root([b"a", b"a"]) != merkle_root([])


def expected(library, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library.library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store(spark, tmp_path, library):
    long = " ".join(f"word{i % 977}" for i in range(9000))
    rows = [(5, "a b"), (1, None), (9, ""), (3, long), (2, long), (None, "last"), (4, long + " more")]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id bigint, text string, shard int, digest binary").repartition(3)
    path = f"file://{tmp_path}/store"
    write_store(docs, path, PATH, 2)
    got = sorted(map(tuple, verify(spark, path).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == expected(library, rows)
    ids = {r.doc_id: r.ids for r in read_documents(spark, path, spark.createDataFrame([(3,), (9,)], "doc_id bigint")).collect()}
    assert ids == {3: library.library.encode(long, add_special_tokens=False).ids + [2], 9: [2]}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(len(r.chunks) for r in spark.read.parquet(f"{path}/documents").collect())
    # a damaged and a missing chunk
    chunks.selectExpr("digest", "n", "IF(n > 100, concat(substring(data, 3), X'0102'), data) AS data").write.parquet(f"{path}/bad")
    (tmp_path / "store" / "chunks").rename(tmp_path / "good")
    (tmp_path / "store" / "bad").rename(tmp_path / "store" / "chunks")
    with pytest.raises(Exception, match="damaged"):
        verify(spark, path).collect()
    chunks = spark.read.parquet(f"{tmp_path}/good")
    chunks.where("n < 100").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="missing chunk"):
        verify(spark, path).collect()


def test_manifest_is_checked(spark, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(200)], "doc_id bigint, text string")
    path = tmp_path / "store"
    write_store(rows.repartition(4), f"file://{path}", PATH, 2)
    assert verify(spark, f"file://{path}").count() == 200
    kept, manifest = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/manifest")
    last = kept.agg(F.max("part")).first()[0]
    damaged = [("documents", kept.where("doc_id != 57")), ("documents", kept.where(F.col("part") != last)), ("documents", kept.union(kept.where("doc_id = 57")))]
    damaged += [("documents", kept.withColumn("before", F.col("before") + F.when(F.col("doc_id") == 57, 1).otherwise(0)))]
    damaged += [("manifest", manifest.where(F.col("part") != last)), ("manifest", manifest.withColumn("offset", F.col("offset") + 1)), ("manifest", manifest.withColumn("root", F.lit(b"x")))]
    for k, (name, rows) in enumerate(damaged):
        copy = tmp_path / f"copy{k}"
        shutil.copytree(path, copy, ignore=shutil.ignore_patterns(name))
        rows.write.parquet(f"{copy}/{name}")
        with pytest.raises(Exception, match="differs from the manifest"):
            verify(spark, f"file://{copy}").collect()


def test_token_store_shuffles_many_repeats(spark, monkeypatch, library):
    import loam.llm.token_store as module

    monkeypatch.setattr(module, "MOST_BROADCAST", 0)
    rows = [(i, "same text " * 5) for i in range(6)]
    got = sorted(map(tuple, token_store(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()))
    assert got == expected(library, rows)
    assert token_store(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_token_counts(spark, library):
    text = "One line here\n\n\nand another, longer line\nend"
    docs = spark.createDataFrame([(1, text, "t"), (2, None, None), (3, "", "x"), (1, "é" * 70_000, "t")], "doc_id bigint, text string, n_tokens string")
    ids, spans = library.spans(text)
    for rule in ("start", "end", "share"):
        got = [r for r in count_tokens(docs, PATH, rule=rule).collect() if r.n_chars == len(text)][0]
        lines, at, counts = text.split("\n"), 0, []
        for k, line in enumerate(lines):
            end = at + len(line) + (k < len(lines) - 1)
            if rule == "share":
                counts.append(sum(max(0, min(b, end) - max(a, at)) / (b - a) for a, b in spans.tolist()))
            else:
                counts.append(sum(at <= (a if rule == "start" else b - 1) < end for a, b in spans.tolist()))
            at = end
        assert got.section_tokens == pytest.approx(counts) and sum(counts) == pytest.approx(len(ids)) and got.n_tokens == len(ids)
    rest = {(r.doc_id, r.n_chars): (r.n_tokens, r.n_sections, r.section_tokens) for r in count_tokens(docs, PATH).collect()}
    assert rest[2, 0] == rest[3, 0] == (0, 1, [0.0]) and rest[1, 70_000][1] == 1
    fields = count_tokens(docs, PATH, fields=("text", "n_tokens")).collect()
    assert all(r.n_sections == 2 and sum(r.section_tokens) == r.n_tokens for r in fields)
    assert count_tokens(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        count_tokens(docs, PATH, rule="none")


def test_crossing_tokens_are_allocated():
    spans, ends = np.array([[0, 2], [2, 6], [6, 8]]), np.array([3, 5, 8])
    assert allocate(spans, ends, "start")[0].tolist() == [2, 0, 1]
    assert allocate(spans, ends, "end")[0].tolist() == [1, 0, 2]
    counts, crossing = allocate(spans, ends, "share")
    assert counts.tolist() == [1.25, 0.5, 1.25] and crossing == 1


@given(st.text(st.sampled_from("<|\\n>a\nim_end"), max_size=30))
def test_escapes(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb"]), ODD), max_size=5))
def test_render_and_mask(block):
    library = chat_library()
    text, spans = render(block, ("assistant",))
    assert turns(text) == block
    ids, tokens = library.spans(text)
    mask, found = intersect(tokens, spans)
    assert "".join(text[a:b] for a, b in found) == "".join(escape(t) for r, t in block if r == "assistant")
    assert not any(m for m, i in zip(mask, ids.tolist(), strict=True) if i >= 50_257)


_made = []


def chat_library():
    if not _made:
        _made.append(Encoder(PATH, special=("<|im_start|>", "<|im_end|>")))
    return _made[0]


def test_chat_format(spark, tmp_path, monkeypatch):
    import hashlib

    import loam.llm.chat_format as module

    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", "\n\nhi\n"), (3, None, "assistant", "late"), (None, 0, "assistant", "no id")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " * 3) for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int").repartition(4)
    for block in (1_000_000, 100):
        monkeypatch.setattr(module, "BLOCK", block)
        got = {r.conv_id: r for r in chat_format(df, PATH).collect()}
        assert len(got) == 5
        for conv in got:
            own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
            whole, loss = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own), "".join(r[3] or "" for r in own if r[2] == "assistant")
            text, _ = render([(r[2] or "", r[3] or "") for r in own], ("assistant",))
            assert tuple(got[conv]) == (conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    monkeypatch.setattr(module, "BLOCK", 1_000_000)
    out = format_chats(df.where("conv_id = 4").coalesce(1), f"file://{tmp_path}/chats", PATH).orderBy("part", "block").collect()
    ids = [i for r in out for i in r.ids]
    assert ids == chat_library().library.encode("".join(r.formatted for r in out), add_special_tokens=False).ids
    assert chat_format(df.limit(0), PATH).count() == 0
