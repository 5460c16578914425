"""What the queries' contracts fix, on rows made for it."""

import random
import zlib

import numpy as np
import pytest

from latticework.llm import packing, token_files, topk, word_tokens
from latticework.llm.common import free_names, remove, stored, table_path

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string"


def _odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<", "hello", "It's", " ", "  ", "\n", "\t", "\r\n", "é", "é", "ß", "Σ", "日本", "123", "don't", "\x1c", "\x85", " ", "　", "!!", "ⅷ", "ﬁ", "İ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok, e = Tokenizer.from_file(path), word_tokens.encoder(path)
    for t in [*_odd_texts(6000, 1), "hello <|endoftext|> world", None, ""]:
        assert np.frombuffer(e.encode(t, 7), "<u4").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 7], t


def test_token_files_and_packing_of_odd_texts(spark):
    """Null and repeated ids, null and empty texts, added tokens: the files' rows and the packed pieces hold the library's ids."""
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(_odd_texts(150, 2))] + [(None, "no id"), (200, None), (201, ""), (202, "twice"), (202, "twice"), (203, "w " * 9000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = lambda t, end: np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")
    at = table_path(spark, "odd_tokens")
    token_files.write(docs, at, path, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, at).collect())
    want, before = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = ids(t, 2)
        want.append((before, d, len(x), zlib.crc32(x.tobytes())))
        before += len(x)
    assert got == want
    pieces = {}
    for r in packing.pack(docs, path, 1).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        x = ids(t, 1)
        assert all(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for r in pieces[d])
        assert sum(r.length for r in pieces[d]) == len(x) * sum(y == d for y, _ in rows)


def test_files_are_skipped_by_their_metadata(spark):
    """The ORC files carry row indexes and a Bloom filter for doc_id, and hold disjoint ranges of it."""
    import pyarrow.orc as orc

    docs = spark.range(20000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text")
    at = table_path(spark, "indexed")
    token_files.write(docs, at, public.path("word_bpe_49k.json"), 2)
    rows = token_files.read(spark, at, [11, 4000])
    assert [r.doc_id for r in rows.collect()] == [4000]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    ends = []
    for f in spark.read.orc(at).inputFiles():
        file = orc.ORCFile(f.removeprefix("file://").removeprefix("file:"))
        x = file.read(columns=["doc_id"])["doc_id"].to_numpy()
        assert (np.diff(x) > 0).all() and file.row_index_stride == token_files.ROWS_INDEXED and file.compression.lower() == "zstd"
        ends.append((x[0], x[-1]))
    ends.sort()
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def _vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<double>{extra}")


@pytest.mark.parametrize("big", [1e6, 3e7, 1e10, 1e19])
def test_topk_of_large_components(spark, big):
    """Products in doubles, 64-bit and unbounded integers are exact; a score that is no 64-bit integer is an error."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-3, 3)), rng.choice([-1, 1]) * 0.3, 0.0]) for i in range(0, 120)] + [(500, [0.0, 0.0, big]), (501, [1.0, 2.0, 1.0 / big])]
    got = topk.search(_vectors(spark, rows), shard=17, block=2).collect()
    v = {i: [int(np.floor(256 * x)) for x in c] for i, c in rows}
    for q in [i for i in v if i % 50 == 0]:
        want = sorted((-sum(a * b for a, b in zip(v[q], v[j], strict=True)), j) for j in v if j != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_topk_beyond_64_bits(spark):
    with pytest.raises(Exception, match="no 64-bit integer"):
        topk.search(_vectors(spark, [(0, [1e10, 1e10]), (1, [1e10, 1e10])])).collect()
    with pytest.raises(Exception, match="too large"):
        topk.search(_vectors(spark, [(0, [1e308]), (1, [1.0])])).collect()


def test_topk_of_odd_rows(spark):
    """No rows, repeated rows, columns that clash with those made inside, null ids, other lengths, null and non-finite components."""
    clash = ", b int, s int, id int, v int, rank int, score int, query_id int"
    rows = [(i, [float(i % 7), 1.0]) for i in range(100)] + [(50, [1.0, 1.0])] * 2 + [(None, [1.0, 1.0]), (150, [1.0]), (200, None), (250, [None, 1.0]), (300, [float("nan"), 1.0]), (350, [])]
    df = _vectors(spark, [(*r, 0, 0, 0, 0, 0, 0, 0) for r in rows], clash)
    got = topk.search(df).collect()
    assert sorted({r.query_id for r in got}) == [0, 50] and all(sum(r.query_id == q for r in got) == 5 for q in (0, 50))
    assert topk.search(df.limit(0)).count() == 0 and topk.search(df.filter("vec_id is null")).count() == 0


def test_free_names_and_removal(spark):
    df = spark.createDataFrame([(1, 2)], "K int, k_ int")
    assert free_names(df, "k", "k", "z") == ["k__", "k___", "z"]
    kept = stored(df, "some")
    assert kept.count() == 1
    files = [f.removeprefix("file://").removeprefix("file:") for f in kept.inputFiles()]
    remove(kept)
    import os

    assert files and not any(map(os.path.exists, files))
