"""Prefix trie, token counts and whitening against brute force and the libraries."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from coachload.llm import decontaminate, exact, lines, minhash, pieces, substring, token_cache, trie, whiten
from coachload.llm.q_documents import BYTE_VOCABULARY, PIECE_MODEL, QUERIES

from .test_operators import brute_components, brute_repeats, planted, rows_of

# -- op 11 ----------------------------------------------------------------------------------------


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, key, role, text))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}


def with_heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members, nodes = defaultdict(list), []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        nodes.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                      hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                               "ends_sha256").collect()), key=str)


CONV = "conv_id long, turn long, role string, text string, depth string, path string, a string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], CONV)


@pytest.fixture(scope="module")
def talk():
    """Shared heads, equal conversations, nulls, repeated rows, long copies."""
    r = random.Random(3)
    rows = []
    for c in range(60):
        stem = r.randrange(4)
        for i in range(r.randint(0, 9)):
            rows.append((c, i, "user" if i % 2 else "bot", f"stem {stem} {i}" if i < 4 and r.random() < 0.9 else f"own {c} {i}é"))
    rows += [(c, i, "user", f"same {i}") for c in range(1000, 1040) for i in range(3)]
    rows += [(c, i, "user", f"long {i}") for c in range(2000, 2010) for i in range(40 + c % 3)]
    rows += [(70, None, None, None), (70, 0, "user", "stem 1 0"), (70, 1, "user", ""), (70, 1, "user", ""), (None, 0, "user", "lost"),
             (71, 0, None, "x"), (72, 0, "", "x"), (73, 0, "x", "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,turns,rows", [(256, 1 << 17, 1 << 15), (256, 20, 5), (2, 1 << 17, 1 << 15), (3, 13, 4), (5, 7, 100), (1, 9, 3)])
def test_trie_equals_brute_force(spark, talk, block, turns, rows):
    paths = trie.as_paths(trie.ordered_turns(trie.turn_digests(chats(spark, talk))))
    assert told(trie.prefix_trie(paths, block, turns, rows)) == brute_trie(ordered(talk))


def test_trie_with_shared_heads(spark, talk):
    convs = ordered(talk)
    assert told(trie.prefix_trie(trie.with_shared_heads(trie.ordered_turns(trie.turn_digests(chats(spark, talk)))), 4, 50, 10)) == \
        brute_trie(with_heads(convs))


def test_a_conversation_over_many_partitions(spark):
    rows = [(1, i, "user", f"turn {i % 50}") for i in range(3000)] + [(2, i, "user", f"turn {i % 50}") for i in range(1500)]
    assert told(trie.prefix_trie(trie.as_paths(trie.ordered_turns(trie.turn_digests(chats(spark, rows)))), 16, 400, 50)) == brute_trie(ordered(rows))


def test_trie_of_nothing(spark):
    assert told(trie.prefix_trie(trie.with_shared_heads(trie.ordered_turns(trie.turn_digests(chats(spark, [])))))) == []


def test_parentheses():
    r = random.Random(9)
    for n in (1, 2, 31, 32, 33, 200, 3000):
        for shape in (lambda e: r.random() < 0.5, lambda e: r.random() < 0.97, lambda e: e < 2):
            steps, excess, left = [], 0, n
            while left or excess:
                up = left and (not excess or shape(excess))
                steps.append(1 if up else -1)
                excess += steps[-1]
                left -= bool(up)
            stack, close = [], {}
            for i, s in enumerate(steps):
                if s > 0:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            opens = np.array(sorted(close))
            assert trie.Parens(np.array(steps, np.int8)).findclose(opens).tolist() == [close[i] for i in opens.tolist()]


def test_op11_query(spark, small):
    import pyarrow.parquet as pq
    rows = [tuple(r.values()) for r in pq.read_table(f"{small}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    assert told(QUERIES["op11_prefix_trie"](spark, small)) == brute_trie(with_heads(ordered(rows)))


# -- op 12 ----------------------------------------------------------------------------------------

def library_counts(texts):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(BYTE_VOCABULARY)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


SPECIAL = [(40, "a<|endoftext|>b <|endoftext|> "), (41, "<|endoftext|>"), (42, "  \n\n  x  \t y 's 'S don't　z\xa0 é")]


def test_counts_equal_the_library(spark, make, odd, tmp_path):
    rows = odd + SPECIAL
    got = rows_of(token_cache.count_tokens(make(rows), str(tmp_path / "c"), BYTE_VOCABULARY))
    want = [(i, len((t or "").encode()), n) for (i, t), n in zip(rows, library_counts([t for _, t in rows]))]
    assert sorted(((g["doc_id"], g["n_bytes"], g["n_tokens"]) for g in got), key=str) == sorted(want, key=str)
    assert not any(g["cached"] for g in got)


def test_only_distinct_misses_are_encoded_and_appended(spark, make, odd, tmp_path, words):
    cache = str(tmp_path / "c")
    token_cache.count_tokens(make(odd), cache, BYTE_VOCABULARY).collect()
    version = token_cache.tokenizer_version(BYTE_VOCABULARY)
    entries = token_cache.read_cache(spark, cache, version)
    assert entries.count() == len({t or "" for _, t in odd})
    for more in ([(50, words(20, 7))], [(60 + i, words(20, 70 + i)) for i in range(40)]):    # few misses, many misses
        rows = odd + more + more
        got = rows_of(token_cache.count_tokens(make(rows), cache, BYTE_VOCABULARY))
        assert sorted((g["n_tokens"] for g in got)) == sorted(library_counts([t for _, t in rows]))
        assert all(g["cached"] == (g["doc_id"] not in dict(more)) for g in got)
    assert token_cache.read_cache(spark, cache, version).count() == len({t or "" for _, t in odd}) + 41
    batches = os.listdir(f"{cache}/version={version}")
    assert len(batches) == 3
    assert all(g["cached"] for g in rows_of(token_cache.count_tokens(make(odd), cache, BYTE_VOCABULARY)))    # nothing new, no batch
    assert sorted(os.listdir(f"{cache}/version={version}")) == sorted(batches)


def test_entries_that_two_jobs_appended(spark, make, tmp_path):
    cache, rows = str(tmp_path / "c"), [(1, "one two"), (2, "three")]
    token_cache.count_tokens(make(rows), cache, BYTE_VOCABULARY).collect()
    path = f"{cache}/version={token_cache.tokenizer_version(BYTE_VOCABULARY)}"
    [batch] = os.listdir(path)
    spark.read.parquet(f"{path}/{batch}").write.parquet(f"{path}/batch=again")
    got = rows_of(token_cache.count_tokens(make(rows), cache, BYTE_VOCABULARY))
    assert sorted((g["doc_id"], g["n_tokens"]) for g in got) == [(1, 2), (2, library_counts(["three"])[0])]


def test_versions_do_not_meet(spark, make, tmp_path):
    import sentencepiece
    cache, rows = str(tmp_path / "c"), [(1, "one two three"), (2, None)]
    token_cache.count_tokens(make(rows), cache, BYTE_VOCABULARY).collect()
    got = {g["doc_id"]: g for g in rows_of(token_cache.count_tokens(make(rows), cache, PIECE_MODEL))}
    assert not got[1]["cached"] and got[2]["n_tokens"] == 0
    assert got[1]["n_tokens"] == len(sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL).encode("one two three"))


def test_counts_of_an_empty_table(spark, make, tmp_path):
    assert rows_of(token_cache.count_tokens(make([]).limit(0), str(tmp_path / "c"), BYTE_VOCABULARY)) == []


def test_pieces_of_long_texts(words):
    r = random.Random(4)
    parts = ["word", " ", "  ", "\n", ".", "é", "<|endoftext|>", "12", "'s", " \t", "　", " end"]
    for n in (50, 400):
        text = "".join(r.choice(parts) for _ in range(n))
        for most in (1, 3, 10, 64):
            cut = token_cache.pieces_of(text, most)
            assert "".join(cut) == text
            assert sum(library_counts(cut)) == library_counts([text])[0]
    assert token_cache.pieces_of("x" * 300, 10) == ["x" * 300]


def test_op12_query(spark, small):
    import pyarrow.parquet as pq
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    want = {d["doc_id"]: n for d, n in zip(docs, library_counts([d["text"] for d in docs]))}
    got = rows_of(QUERIES["op12_token_counts"](spark, small))
    assert {g["doc_id"]: g["n_tokens"] for g in got} == want and len(got) == len(docs)
    assert all(g["over_limit"] == (g["n_tokens"] > 512) for g in got)


# -- op 13 ----------------------------------------------------------------------------------------

def brute_whiten(rows, k=4):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), float)
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in kept:
        w = ((np.array(v) - s / n) @ u[:, :k]) / np.sqrt(e[:k])
        dev = sum((n * a - int(b)) ** 2 for a, b in zip(v, s))
        out += [(i, j + 1, n, dev, w[j], e[j] / e.sum()) for j in range(min(k, len(e)))]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, n double")


def same_whitening(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], round(abs(r[4]), 3))
    got = sorted(((g["vec_id"], g["component"], g["n"], int(g["deviation"]), g["whitened"], g["explained"]) for g in got), key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for c in {g[1] for g in got}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want))
        sign = np.sign(a @ b)
        assert np.abs(a - sign * b).max() < 1e-6
    assert max(abs(g[5] / w[5] - 1) for g, w in zip(got, want)) < 1e-6


def test_whitening_equals_dense_algebra(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=(300, 7)) * [9, 5, 4, 3, 2, 1, .5] + 40).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(None, x[0].tolist()), (1, x[1].tolist()), (400, x[2].tolist())]
    bad = [(500, None), (501, []), (502, [None] * 7), (503, [float("nan")] * 7), (504, [float("inf")] + [0.0] * 6), (505, [1.0, 2.0])]
    got = rows_of(whiten.whiten(vectors(spark, rows + bad)))
    same_whitening(got, brute_whiten(rows))
    assert {g["identity_error"] for g in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    assert rows_of(whiten.whiten(vectors(spark, []))) == []
    got = rows_of(whiten.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])))
    assert len(got) == 4 and {(g["n"], g["deviation"], g["whitened"], g["explained"]) for g in got} == {(1, "0", None, None)}
    line = rows_of(whiten.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])))
    assert all((g["whitened"] is None) == (g["component"] > 1) for g in line) and line[0]["identity_error"] < 1e-9


def test_exact_sums_beyond_a_long(spark):
    big = [(i, [float(2.0 ** 50 * (i + 1)), float(i % 3)]) for i in range(9)]
    got = rows_of(whiten.whiten(vectors(spark, big), components=1))
    xs = [[int(c * 256) for c in v] for _, v in big]
    total = [sum(c) for c in zip(*xs)]
    assert {g["vec_id"]: int(g["deviation"]) for g in got} == \
        {i: sum((9 * c - t) ** 2 for c, t in zip(x, total)) for (i, _), x in zip(big, xs)}


def spectrum(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    v = (q * values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 5, 40), np.ones(12), np.r_[np.ones(6), 2 * np.ones(6)], np.r_[1 + 1e-9 * np.arange(9), 2, 3],
                                    np.r_[1 + 1e-12 * np.arange(5), 1 + 1e-6 * np.arange(5), 4], np.r_[np.zeros(9), 1, 2], np.zeros(3), [7.0]])
def test_refined_eigenvectors(values):
    v = spectrum(np.asarray(values, float))
    e, x = whiten.eigen(v)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(v @ x - x * e).max() / size < 1e-14
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-15
    assert (np.diff(e) <= 1e-15 * size).all()


def test_refinement_beats_its_start():
    v = spectrum(np.linspace(1, 2, 64))
    start = np.linalg.eigh(v.astype(np.float32))[1].astype(float)
    away = lambda x: np.abs(v @ x - x * np.einsum("ij,ij->j", x, v @ x)).max()
    assert away(whiten.eigen(v)[1].astype(float)) < 1e-8 * away(start)


def test_op13_query(spark, small):
    import pyarrow.parquet as pq
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{small}/embeddings.parquet").to_pylist()]
    got = rows_of(QUERIES["op13_whitening"](spark, small))
    same_whitening(got, brute_whiten(rows))
    assert got[0]["identity_error"] < 1e-9


# -- rows without an id, or with the same one -----------------------------------------------------

@pytest.mark.parametrize("ids", [(None, None), (7, 7)])
def test_texts_of_one_id_with_equal_ties(make, words, monkeypatch, ids):
    """The short hash of both texts is forced to be equal: only the copy goes."""
    monkeypatch.setattr(substring, "tie_of", lambda text: 5)
    monkeypatch.setattr(lines, "tie_of", lambda text: 5)
    one, other = words(40, 31), words(40, 32)
    rows = [(1, one), (ids[0], one), (ids[1], other), (ids[1], other)]
    got = sorted((r["n_words"], r["n_removed"]) for r in rows_of(substring.remove_repeats(make(rows), 20)))
    assert got == [(40, 0), (40, 0), (40, 0), (40, 40)]
    got = sorted((r["n_lines"], r["n_removed"]) for r in rows_of(lines.remove_lines(make(rows))))
    assert got == [(1, 0), (1, 0), (1, 0), (1, 1)]


def test_lines_that_share_half_their_hash(make, words, monkeypatch):
    monkeypatch.setattr(lines, "line_ids", lambda line: (3, lines.signed(__import__("xxhash").xxh3_64_intdigest(line))))
    rows = [(i, words(8, 50 + i)) for i in range(4)] + [(9, words(8, 50))]
    got = {r["doc_id"]: r["n_removed"] for r in rows_of(lines.remove_lines(make(rows)))}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 1}


def test_windows_of_fifty_words(make, odd, words):
    rows = odd + [(20 + i, words(70, 9) + " " + words(30, 90 + i)) for i in range(4)]
    got = sorted((str(r["doc_id"]), r["n_removed"], r["kept_sha256"]) for r in rows_of(substring.remove_repeats(make(rows), 50)))
    assert got == sorted((str(i), n, sha) for i, _, n, sha in brute_repeats(rows, 50))


def test_long_lists_are_dealt_out(make, odd, words, monkeypatch):
    """Blocks of four members, or of few shingles; lists of two blocks or more are posted again."""
    rows = [x for x in odd if x[0] != 9] + planted(words)
    for block, size in ((4, 1 << 22), (4096, 300)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "SHINGLES", size)
        monkeypatch.setattr(minhash, "LONG", 1)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(minhash.near_copies(make(rows), 80, 5))]
        assert sorted(map(str, got)) == sorted(map(str, brute_components(rows, 5, 80)))


def test_second_dealing_keeps_the_pigeonhole():
    for percent in (80, 85):
        need = minhash.agreement(percent)
        groups = minhash.second_groups(need)
        assert len(groups) == minhash.K - need + 1 and sorted(np.concatenate(groups)) == list(range(minhash.K))


def test_text_item_ids(make, spark, words):
    passage = words(12, 3)
    items = spark.createDataFrame([("a/1", passage), ("b", words(12, 4))], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in rows_of(decontaminate.decontaminate(make([(1, "x " + passage), (2, "y")]), items))}
    assert got == {1: ["a/1"], 2: []}


def test_exact_with_names_of_its_own(make):
    docs = make([(1, "a b"), (1, "ab"), (2, "ab"), (3, "c"), (3, "c")]).selectExpr("*", "1 AS __id", "2 AS __row", "3 AS `__sha`", "4 AS ___chars")
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in rows_of(kept)) == [(1, "a b"), (3, "c")]


def test_every_path_decodes_to_the_text(make, odd):
    got = rows_of(pieces.encode(make([x for x in odd if x[0] != 9]), PIECE_MODEL))
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)


# -- op 3 -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("broadcast", [1 << 40, 0])
def test_scores_follow_the_bigram_formula(make, words, odd, broadcast):
    """Against the formula on exact counts at the filter's levels: a false hit, one probe in
    about 200, raises a count by a level."""
    import math
    from collections import Counter

    from coachload.llm import lm
    r = random.Random(6)
    vocabulary = words(300, 5).split()
    rows = odd + [(100 + i, " ".join(r.choices(vocabulary, k=r.randint(5, 200)))) for i in range(150)]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tok = lambda t: [b" begin", *(t or "").encode().lower().split(), b" end"]
    ones, twos = Counter(), Counter()
    for i, t in rows:
        if not out(i):
            ones.update(tok(t))
            twos.update(zip(tok(t), tok(t)[1:]))
    n = sum(c for w, c in ones.items() if w != b" begin")
    v = len(ones) - 1
    values = lm.level_counts(lm.BASE)
    level = lambda c: float(values[int(lm.levels(np.array([c]), lm.BASE)[0])]) if c else 0.0

    def score(t):
        total = 0.0
        for a, b in zip(tok(t), tok(t)[1:]):
            p = (level(ones[b]) + lm.ADD) / (n + lm.ADD * (v + 1))
            p = (min(level(twos[a, b]), level(ones[a])) + lm.MU * p) / (level(ones[a]) + lm.MU)
            total += math.log10(min(p, 1.0))
        return total

    want = sorted((str(i), len(tok(t)) - 1, score(t)) for i, t in rows)
    got = sorted((str(x["doc_id"]), x["n_tokens"], x["score"]) for x in rows_of(lm.score_documents(make(rows), broadcast_bytes=broadcast)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    away = [abs(g[2] - w[2]) / g[1] for g, w in zip(got, want)]
    assert np.mean(away) < 0.01 and max(away) < 0.5


# -- the pipeline on odd rows ---------------------------------------------------------------------

def test_pipeline_stages_on_odd_rows(spark, make, odd, words, tmp_path):
    """Nulls, empty, blank and very long texts, repeated rows and ids, clashing
    columns, and nothing at all: every stage keeps the columns, and clean texts."""
    import corpus_pipeline
    labels = [(i, i % 2, 0) for i in range(1, 30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, words(30, 77)), (None, "x"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [x for x in odd if x[0] != 9] + [(30 + i, words(50, 300 + i)) for i in range(5)] + [(40, "a " + words(30, 77))]
    for data in (rows, []):
        docs = make(data).drop("kept", "rid") if data else make(rows).limit(0)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = out
        kept = {x["doc_id"] for x in rows_of(docs)}
        assert not data or {30, 31, 32, 33, 34} <= kept and 40 not in kept
        ids = rows_of(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)))
        assert len(ids) == docs.count()
        first = corpus_pipeline.STAGES[0][1](spark, make(data) if data else make(rows).limit(0), str(tmp_path))
        assert set(first.columns) == set(make(rows).columns) and first.count() <= len(data)


def test_index_shards_follow_the_rows(make, words, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_ROWS", 3)
    rows = [(i, words(3, i % 40)) for i in range(90)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows_of(exact.exact_copies(make(rows)))}
    assert got == {i: (i % 40, 3 if i % 40 < 10 else 2) for i, _ in rows}
