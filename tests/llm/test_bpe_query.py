"""op3's own columns against the public library; long pieces."""

import hashlib

import numpy as np
import pytest

from latticework.llm import bpe

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def _library():
    ranks = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark, tmp_path):
    """Every document of a table with null and empty texts, marks, special tokens' strings and repeats."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(900, None), (901, ""), (902, "<|endoftext|> a\u0301 \U0001f600\x00"), (903, "twice"), (903, "twice"), (None, " x\n\n y")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    enc, want = _library(), []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_long_pieces(monkeypatch, block):
    """Unbroken runs, cut into blocks of matches of any size."""
    monkeypatch.setattr(bpe, "BLOCK", block)
    c, rng = bpe.Codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN), np.random.default_rng(1)
    enc = _library()
    for letters, n in (("ab", 3000), ("etaoinshrdlu", 5000), ("é日本", 900), ("x", 2000), ("=-", 1500)):
        t = "".join(rng.choice(list(letters), n))
        assert c.encode(t) == np.array(enc.encode_ordinary(t), "<u4").tobytes()
