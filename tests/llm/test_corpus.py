"""The corpus operators against brute force, the public libraries, SQL, and odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from latticework.llm import bpe, curves, language_id, line_dedup, packing, passage_dedup, simhash, suffix_dedup, token_files, topk
from latticework.llm.common import components, table_path
from latticework.llm.suffix_sort import suffix_array

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by 1").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, equal ids, a long text, and columns that clash."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, None, None, None, None), (None, "a null id here", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, "same text", "en", "s", 9), (4, "same text", "en", "s", 9), (4, "another text", "fr", "s", 9), (5, long, "en", "s", len(long)), (6, "1234 !!", "en", "s", 7), (7, "été́ \x1c 日本 <|endoftext|>", "fr", "s", 1)]
    names = "score int, lang_pred int, fp string, k string, removed string, n_removed string, n_words int, ids string"
    return spark.createDataFrame([(*r, 0, 0, "", "", "", "", 0, "") for r in rows], f"{SCHEMA}, {names}")


def test_odd_and_empty_rows(spark, odd):
    model = language_id.fit(odd)
    for df in (odd, odd.limit(0)):
        n = df.count()
        pred = language_id.predict(df, model)
        assert pred.count() == n and {r.lang_pred for r in pred.collect() if not (r.text or "").strip() or r.doc_id == 6} <= {"und"}
        assert language_id.predict(df, language_id.fit(df.limit(0))).filter("lang_pred <> 'und'").count() == 0
        assert simhash.near_duplicates(df).count() == n
        assert simhash.keep_one(df).count() <= n
        coded = bpe.decode(bpe.encode(df, public.path("byte_bpe_50k.tiktoken"), public.PATTERN), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
        assert coded.count() == n and all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
        assert suffix_dedup.mark_repeats(df).count() == n
        assert line_dedup.dedup_lines(df).count() == n
        assert passage_dedup.dedup_passages(df).count() == n
        path = table_path(spark, "odd")
        token_files.write(df, path, public.path("word_bpe_49k.json"), 2)
        assert token_files.digests(spark, path).count() == n
        assert packing.pack(df, public.path("word_bpe_49k.json"), 1).count() >= n
    prints = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert prints[1, "0" * 16] == prints[2, "0" * 16] == prints[None, "0" * 16] == 1


def test_language_id(spark, docs):
    got = {r.doc_id: r for r in language_id.query(spark, SF).collect()}
    held = [d for d, _, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    truth = {d: lang for d, _, lang in docs}
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held)


def test_simhash(spark, docs):
    fps = {}
    for d, t, _ in docs:
        w = t.encode().lower().split()
        n = max(1, len(w) - 2) if w else 0
        c = [0] * 64
        for i in range(n):
            h = xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42)
            for b in range(64):
                c[b] += h >> b & 1
        fps[d] = sum(1 << b for b in range(64) if 2 * c[b] > n)
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[b] > label[a]:
                    label[b], changed = label[a], True
    got = {r.doc_id: r for r in simhash.query(spark, SF).collect()}
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (format(f, "016x"), label[d]) for d, f in fps.items()}


def test_spanning_links_and_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (3, 64))
    rows = np.unique(np.array([np.packbits(base[i % 3] ^ (rng.random(64) < 0.06)) for i in range(400)]), axis=0)
    v = rows.view(np.uint64).ravel()
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3

    def groups(pairs):
        label = list(range(len(v)))
        for _ in range(len(v)):
            before = list(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    want = groups(list(zip(*np.nonzero(near), strict=True)))
    links = simhash.spanning_links(rows, 3)
    assert len(links) < len(v) and groups(links) == want
    df = spark.createDataFrame([(bytes(r),) for r in rows], "fp binary")
    index = {bytes(r): i for i, r in enumerate(rows)}
    tiled = simhash.links(df, simhash.Plan(tile=7)).collect()
    assert groups([(index[bytes(r.src)], index[bytes(r.dst)]) for r in tiled]) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    c = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(3)
    texts = [t for _, t, _ in docs[:60]] + ["".join(rng.choice("abcXYZ 'sré tmlß<|>0123²½Σé.,!?\x1c\x85 \n日本") for _ in range(rng.randrange(20))) for _ in range(2000)] + ["ab" * 5000]
    for t in texts:
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert c.encode(t) == ids and c.decode(ids) == t.encode()


def test_token_files_and_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = {d: tok.encode(t, add_special_tokens=False).ids for d, t, _ in docs}
    got, before = {r.doc_id: r for r in token_files.query(spark, SF).collect()}, 0
    for d in sorted(ids):
        x = np.array([*ids[d], 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (before, len(x), zlib.crc32(x.tobytes()))
        before += len(x)
    rows, seqs = packing.query(spark, SF).collect(), {}
    for d in ids:
        x, at = np.array([*ids[d], 1], "<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == seqs.get(r.sequence_id, 0)
        seqs[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in seqs.values())
    path = table_path(spark, "tokens")
    token_files.write(spark.read.parquet(f"{SF}/documents.parquet"), path, public.path("word_bpe_49k.json"), 2)
    assert [r.doc_id for r in token_files.read(spark, path, [docs[5][0]]).collect()] == [docs[5][0]]


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("large", [32768, 1])
def test_suffix_dedup(spark, docs, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    texts, count = {d: t.encode() for d, t, _ in docs}, {}
    for b in texts.values():
        for i in range(len(b) - 199):
            count[b[i : i + 200]] = count.get(b[i : i + 200], 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.query(spark, SF).collect()}
    for d, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), gone.sum(), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("module", [line_dedup, topk])
def test_sql(spark, module):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = module.query(spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(db.execute(f"select {', '.join(cols)} from ({module.ORACLE_SQL})").fetchall())


def test_topk_tree_and_ties(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 4)) / 2.0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (None, [1.0] * 4), (901, [float("nan")] * 4), (902, [None] * 4)]
    got = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), shard=11, block=3).collect()
    f = np.floor(256 * v).astype(int)
    for q in range(0, 300, 50):
        want = sorted((-int(f[q] @ f[j]), j) for j in range(300) if j != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_passages(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(5000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages, rows, planted = [some(60) for _ in range(4)], [], {}
    for i in range(120):
        w = some(rng.randint(30, 200))
        if i % 6 == 1:
            p = list(passages[i % 4])
            if i > 40:
                p[30] = "changed"
            at = rng.randint(0, len(w))
            w, planted[i] = w[:at] + p + w[at:], i % 4
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r.doc_id: r for r in passage_dedup.dedup_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = {g: min(i for i, x in planted.items() if x == g) for g in planted.values()}
    for i in range(120):
        later = i in planted and first[planted[i]] != i
        assert (57 <= got[i].n_removed <= 63) if later else got[i].n_removed == 0
        assert len(got[i].text.split()) == got[i].n_words - got[i].n_removed


def _gone(spark, texts, **seeds):
    """Per text the places of its words that go (texts of words that occur once in a text)."""
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)]
    got = {r.doc_id: set(r.text.split()) for r in passage_dedup.dedup_passages(spark.createDataFrame(rows, SCHEMA), **seeds).collect()}
    return [[p for p, x in enumerate(w) if x not in got[i]] for i, w in enumerate(texts)]


def test_passages_along_a_chain(spark):
    some = lambda n, tag: [f"{tag}x{i}" for i in range(n)]
    for gap in (15, 40, 140):  # two passages with other words between
        p, q = some(61, "p"), some(63, "q")
        a, b = some(20, "a") + p + some(gap, "c") + q, some(30, "b") + p + some(gap, "d") + q + some(9, "e")
        assert _gone(spark, [a, b]) == [[], [*range(30, 91), *range(91 + gap, 154 + gap)]]
    for n, gone in ((10, range(0, 210)), (12, range(52, 212))):  # words inserted after the 40th; beyond ten the first part is no passage
        p = some(200, "p")
        assert _gone(spark, [p, p[:40] + some(n, "i") + p[40:]]) == [[], [*gone]]
    s, p = some(12, "s"), some(60, "p")  # a stray phrase first
    assert _gone(spark, [s + some(30, "a") + p, s + some(33, "b") + p]) == [[], [*range(45, 105)]]


def test_passages_whose_parts_occur_earlier(spark):
    rng = random.Random(5)
    texts, want = [], {}
    for g in range(60):
        some = lambda n, tag: [f"{g}{tag}{i}" for i in range(n)]  # noqa: B023, E731
        p = some(rng.randint(51, 60), "p")
        for n, size in enumerate((25, 25, 30)[: rng.randint(1, 3)]):  # stretches of it in earlier documents, and between its two copies
            at = rng.randint(0, len(p) - size)
            texts.append(some(10, f"a{n}x") + p[at : at + size] + some(10, f"b{n}x"))
        texts.append(some(15, "c") + p + some(15, "d"))
        for n in range(4):
            at = rng.randint(0, len(p) - 30)
            texts.append(some(10, f"e{n}x") + p[at : at + 30] + some(10, f"f{n}x"))
        want[len(texts)] = range(12, 12 + len(p))
        texts.append(some(12, "g") + p + some(12, "h"))
    gone = _gone(spark, texts)
    for i in range(len(texts)):
        assert gone[i] == [*want.get(i, ())]


def test_passages_with_many_edits(spark):
    rng = random.Random(9)
    for edits, least in ((6, 39), (9, 37), (12, 32)):  # of 40 passages of 60 words: similarity 0.9, 0.85 and 0.8
        texts = []
        for g in range(40):
            p = [f"{g}p{i}" for i in range(60)]
            changed = set(rng.sample(range(60), edits))
            copy = [f"{g}q{i}" if i in changed else w for i, w in enumerate(p)]
            texts += [[f"{g}a{i}" for i in range(40)] + p, [f"{g}b{i}" for i in range(30)] + copy + [f"{g}c{i}" for i in range(30)]]
        gone = _gone(spark, texts, seed=4, window=6)
        assert not any(gone[::2]) and sum(len(x) >= 50 for x in gone[1::2]) >= least
        assert all(30 <= x[0] and x[-1] < 90 for x in gone[1::2] if x)


def test_exact_windows(spark):
    """Brute force: no window of 50 words stays whole in two places, and words go only if such a window (or one that is similar) holds
    them; texts of few words, with repeats inside a text."""
    rng = random.Random(6)
    parts = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randint(20, 45))] for _ in range(12)]
    texts = [[w for _ in range(rng.randint(1, 6)) for w in rng.choice(parts)] for _ in range(80)]
    frame = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)], SCHEMA)
    frame = frame.withColumn("doc_id", passage_dedup.F.when(passage_dedup.F.col("doc_id") < 60, passage_dedup.F.col("doc_id") - 60))  # null ids come last
    found = passage_dedup.repeated_passages(frame).withColumnsRenamed({"d": "d0", "k": "k0"})
    d, k = passage_dedup._ident("text")
    rows = frame.join(found, (d == found.d0) & (k == found.k0), "left").select("text", "spans").distinct().collect()
    assert len(rows) == len({tuple(w) for w in texts})
    whole, repeated = {}, {}
    for r in rows:
        w = r.text.split()
        gone = {x for s in r.spans or () for x in range(s.s, s.e)}
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            repeated[key] = repeated.get(key, 0) + 1
            whole[key] = whole.get(key, 0) + (not gone & set(range(p, p + 50)))
    assert sum(n > 1 for n in repeated.values()) > 500 and max(whole.values()) == 1
    h = passage_dedup.window_hashes(passage_dedup.word_hashes(" ".join(texts[0] * 3)))
    w = texts[0] * 3
    assert len({(int(h[i]), tuple(w[i : i + 50])) for i in range(len(h))}) == len(set(h.tolist())) == len({tuple(w[i : i + 50]) for i in range(len(h))})


def test_passages_of(spark):
    rng = random.Random(3)
    for _ in range(300):
        found, x, y = [], 0, 0
        for _ in range(rng.randint(1, 9)):
            n = rng.randint(1, 40)
            found.append((x, y, n))
            x, y = x + n + rng.randint(0, 14), y + n + rng.randint(0, 14)
        want = set()
        for s in range(len(found)):
            for e in range(s, len(found)):
                gaps = [max(found[i + 1][c] - found[i][c] - found[i][2] for c in (0, 1)) for i in range(s, e)]
                same, hi = sum(f[2] for f in found[s : e + 1]), found[e][0] + found[e][2]
                if all(g <= 10 for g in gaps) and same >= 0.8 * (same + sum(gaps)) - 1e-6 and hi - found[s][0] >= 50:
                    want |= set(range(found[s][0], hi))
        assert {w for lo, hi, _, _ in passage_dedup.passages_of(found) for w in range(lo, hi)} == want


def test_chains():
    assert passage_dedup.chains([0, 10, 20, 500], [3, 13, 22, 1]) == [[0, 1, 2], [3]]


def test_near_duplicate_stage(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    rows, group = [], {}
    for g in range(40):
        base = [rng.choice(words) for _ in range(200)]
        for c in range(3):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(200)] = rng.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    kept = [r.doc_id for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()]
    assert sorted(kept) == [min(i for i, x in group.items() if x == g) for g in range(40)]


def test_near_duplicates_are_similar(spark):
    """Brute force: texts around the similarity of 0.8 in groups, short texts, links that are rejected."""
    rng = random.Random(11)
    texts = []
    for g in range(60):
        base = [f"{g}w{i}" for i in range(120)]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 3, 4, 5, 6):
            copy = list(base)
            for _ in range(n):
                copy[rng.randrange(120)] = f"{g}n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i // 8 * 8, i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    want = {i for i in range(len(texts)) if label[i] == i}
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert want <= got  # no text goes that is similar to none
    assert len(got - want) <= 0.03 * (len(texts) - len(want))


def test_keep_one_of_rows_that_repeat(spark):
    rows = [(1, "a b c d e f g", "en", "t", 1), (1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, "h i j k l m n", "en", "s", 1), (None, "h i j k l m n", "en", "s", 1)]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text, r.source) for r in got) == [(0, "h i j k l m n", "s"), (1, "a b c d e f g", "s")]


def test_more_links():
    fp = np.zeros((4, 8), np.uint8)
    fp[3] = 255
    assert simhash.more_links(fp, 3, [], []) == [(0, 1), (0, 2)]
    assert simhash.more_links(fp, 3, [], [(0, 1), (2, 0)]) == [(1, 2)]
    assert simhash.more_links(fp, 3, [(0, 1)], [(0, 2)]) == [(1, 2)]
    assert simhash.more_links(fp, 3, [], [(0, 2)], 2) == [(0, 1), (1, 2)]
    assert simhash.more_links(fp, 64, [(1, 2)], [], 1) == [(0, 1), (0, 3)] and len(simhash.more_links(fp, 64, [(1, 2)], [], 2)) == 5


