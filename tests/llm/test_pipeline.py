"""The pipeline stage by stage: each on what its predecessor kept, against plain versions."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from latticework.llm import line_dedup

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
OTHER = " ".join(f"with other words of this {i} and that town" for i in range(12))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of documents with some odd ones added, and what each stage gave on the rows of the one before."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = " ".join(f"p{i}x" for i in range(80))
    odd = [
        (9001, None, "en", "s", None), (9002, "", None, "s", 0), (9003, "12 !!", None, None, 5), (9004, f"the house and the garden of the town {passage}", None, "s", 1), (9005, f"{passage} {OTHER}", None, "s", 1),
        (9006, "one line of text\nanother line of text\na third line of text\nand the end of the first", None, "s", 1), (9007, "a begin of the second\none line of text\nanother line of text\na third line of text", None, "s", 1),
        (9008, docs.orderBy("doc_id").first().text, None, "s", 1), (None, "a text of a document without an id that says little", None, "s", 1),
    ]
    df = docs.select(P.COLUMNS).union(spark.createDataFrame(odd, docs.select(P.COLUMNS).schema))
    rows = [df.collect()]
    for name, stage in P.STAGES:
        stage(spark, df, SF).write.parquet(f"{at}/{name}")
        df = spark.read.parquet(f"{at}/{name}")
        rows.append(df.collect())
        assert name == "packing" or df.columns == P.COLUMNS
    return rows


def test_language_stage_drops_texts_without_a_language(stages):
    given, kept, *_ = stages
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((r.doc_id or 0, r.text) for r in given if r.text and any(c.isalpha() for c in r.text))


def test_line_stage_is_that_of_its_sql(stages, tmp_path):
    _, given, kept, *_ = stages
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(r.doc_id if r.doc_id is not None else 10**9, r.text) for r in given]
    pq.write_table(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}), tmp_path / "d.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/d.parquet'")
    want = {(d, m) for d, n, m in db.execute(f"select doc_id, n_removed, kept_md5 from ({line_dedup.ORACLE_SQL})").fetchall()}
    got = {(r.doc_id if r.doc_id is not None else 10**9, hashlib.md5(r.text.encode()).hexdigest()) for r in kept}
    assert got <= want and {d for d, _ in want - got} <= {d for d, t in rows} and 9007 in {d for d, _ in got}
    assert next(r for r in kept if r.doc_id == 9007).text == "a begin of the second"
    assert all(r.n_chars == len(r.text) for r in kept if r.doc_id in (9006, 9007) and r.text.count("\n") == 0)


def test_near_stage_keeps_one_of_each_group(stages):
    from test_near_and_names import _brute

    given = sorted(stages[2], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    label, _ = _brute([r.text for r in given])
    want = {given[i].doc_id for i in range(len(given)) if label[i] == i}
    got = {r.doc_id for r in stages[3]}
    assert want <= got and len(got - want) <= max(1, 0.03 * (len(given) - len(want))) and 9008 not in got


def test_passage_stage_leaves_no_window_twice(stages):
    given, kept = stages[3], stages[4]
    clean = lambda w: w.lower().strip(".,;:!?\"'()[]{}<>|*#$%&-")
    count = {}
    for r in given:
        w = list(map(clean, r.text.split()))
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            count.setdefault(key, set()).add(r.doc_id)
    again = {k for k, own in count.items() if len(own) > 1}
    left = {}
    for r in kept:
        w = list(map(clean, r.text.split()))
        for p in range(len(w) - 49):
            if (key := tuple(w[p : p + 50])) in again:
                left.setdefault(key, set()).add(r.doc_id)
    assert again and all(len(own) == 1 for own in left.values())
    now = {r.doc_id: r.text for r in kept}
    assert "p40x" in now[9004] and "p40x" not in now[9005] and now[9005].split() == OTHER.split()
    before = {r.doc_id: r.text for r in given}
    assert all(set(t.split()) <= set(before[d].split()) for d, t in now.items())


def test_packing_stage_holds_all_ids(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    pieces = {}
    for r in stages[5]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {r.doc_id for r in stages[4]}
    for r in stages[4]:
        x, at = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(x)


def test_run_is_its_stages(spark):
    """run() gives the rows of the stages one after the other, on a table of its own path."""
    rows = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    whole = lambda rows: sorted({(d, n) for d, _, _, _, n in rows})
    assert whole(key(rows)) == whole(key(docs))
