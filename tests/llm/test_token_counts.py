"""Token counts against the public library, on texts made to be odd and on a whole table."""

import random

import pytest

from latticework.llm import token_counts

public = pytest.importorskip("public_tokenizers")
PARTS = ["<|endoftext|>", "<|endoftext|", "|>", "hello", "It's", "they'LL", " ", "  ", "\n", "\n\n ", "\t", "\r\n", "é", "é", "ß", "Σ", "日本", "123", "٣", "don't", "\x1c", "\x85", " ", "　", "!!", "ⅷ", "ﬁ", "\U0001f600", "՘", "꟎", "\U00016ea0", "\U000323b0", "‍", " ", "zq", "ing", "\x00", "�"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_counts_are_the_librarys(library):
    rng, path = random.Random(5), public.path("byte_bpe_50k.json")
    c = token_counts.TokenCounter(path, token_counts.prove(path))
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(8000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(9)) for _ in range(8000)]
    texts += ["", "x" * 5000, " " * 5000, "ab" * 3000 + "<|endoftext|>" * 3, "<|endoftext|>"]
    for t in texts:
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    assert c.count(None) == 0


def test_whole_tokens_are_proven(library):
    """Every look-up that gives 1 is what the library gives for that string; without any proof the counts stay the same."""
    path = public.path("byte_bpe_50k.json")
    proven = token_counts.prove(path)
    c, bare = token_counts.TokenCounter(path, proven), token_counts.TokenCounter(path, "")
    assert len(c) > 40_000 and not len(bare)
    for piece in random.Random(1).sample(sorted(c), 3000):
        assert len(library.model.tokenize("".join(token_counts.SHOWN[b] for b in piece.encode()))) == 1
        assert bare.count(piece) == c.count(piece)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.prove(public.path("word_bpe_49k.json"))


def test_whole_table_and_odd_rows(spark, library):
    rows = {r.doc_id: r for r in token_counts.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].n_bytes, rows[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 1024)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "café", 3), (2, "café", 3), (3, "w " * 1024, 4), (4, "w " * 1023, 5)], "doc_id bigint, text string, N_Tokens int")
    got = token_counts.count_tokens(odd, public.path("byte_bpe_50k.json"))
    assert sorted(got.columns) == ["doc_id", "n_bytes", "n_tokens", "over_limit", "text"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [(0, 0, 0, False), (1, 0, 0, False), (2, 5, 3, False), (2, 5, 3, False), (3, 2048, 1025, True), (4, 2046, 1024, False)]
    assert token_counts.count_tokens(odd.limit(0), public.path("byte_bpe_50k.json")).count() == 0
