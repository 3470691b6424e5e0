"""Operators on Spark against brute force, on odd rows and planted cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from coachload.llm import decontaminate, exact, lines, lm, minhash, pieces, q_documents, quality, secrets, substring, tokens
from coachload.llm.components import components

SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def split(text):
    return (text or "").encode().split()


def planted(words):
    """Copies, near copies, shared passages, lines one edit apart."""
    r = random.Random(11)
    rows, base = [], [words(80, 100 + i) for i in range(8)]
    passage = words(35, 50)
    for i, b in enumerate(base):
        rows.append((100 + i, b))
        w = b.split()
        for j in range(6):
            v = list(w)
            for _ in range(r.randint(1, 3)):
                v[r.randrange(len(v))] = "changed%d" % r.randrange(99)
            rows.append((200 + 10 * i + j, " ".join(v)))
        rows.append((300 + i, " ".join(w[:40]) + " " + passage + "\n" + " ".join(w[40:])))
    rows += [(400 + i, words(30, 400 + i) + " " + passage + " " + words(30, 500 + i)) for i in range(30)]
    line = words(9, 600)
    for i in range(20):
        p = r.randrange(len(line))
        edit = [line[:p] + line[p + 1:], line[:p] + "Q" + line[p:], line[:p] + "é" + line[p + 1:], line][i % 4]
        rows.append((500 + i, f"  {edit}\t\n\n{words(12, 700 + i)}\n{words(2, 5)}"))
    return rows


# -- op 2 -----------------------------------------------------------------------------------------

def brute_repeats(rows, window):
    docs = {(math.inf if i is None else i, substring.tie_of((t or "").encode()), t) for i, t in rows}
    seen, gone = set(), {}
    for i, tie, t in sorted(docs, key=lambda x: x[:2]):
        w, drop = split(t), set()
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            drop.update(range(a, a + window)) if k in seen else seen.add(k)
        gone[i, t] = b" ".join(x for j, x in enumerate(w) if j not in drop)
    return [(i, len(split(t)), len(split(t)) - len(k.split()), hashlib.sha256(k).hexdigest())
            for i, t in rows for k in [gone[math.inf if i is None else i, t]]]


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring(make, odd, words, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)  # 1: every shared passage takes the window path
    monkeypatch.setattr(substring, "SHARD_SEGMENTS", 20)
    rows = odd + planted(words)
    got = substring.remove_repeats(make(rows), 20, with_text=True)
    found = rows_of(got)
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=key) == sorted(brute_repeats(rows, 20), key=key)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in found)


# -- op 4 -----------------------------------------------------------------------------------------

def test_exact(make, odd, words):
    rows = odd + planted(words) + [(900, "one  two"), (901, "onetwo"), (902, " ")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(b"", (t or "").encode())].append((-len(t or ""), math.inf if i is None else i, i))
    want = []
    for i, t in rows:
        k = SPACE.sub(b"", (t or "").encode())
        best = min(groups[k])
        want.append((i, best[2], len(groups[k]), best[2] == i and -best[0] == len(t or ""), hashlib.sha256(k).hexdigest()))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"]).hex()) for r in rows_of(exact.exact_copies(make(rows)))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = exact.drop_copies(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(SPACE.sub(b"", (r["text"] or "").encode()) for r in rows_of(kept)) == sorted(groups)


def test_exact_drops_the_shorter_copy_of_an_id(make):
    rows = [(1, "a b"), (1, "ab"), (2, "ab"), (3, "c  d"), (3, "c  d"), (3, "cd"), (None, "e f"), (None, "ef")]
    kept = rows_of(exact.drop_copies(make(rows)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "a b"), ("3", "c  d"), ("None", "e f")]


# -- op 5 -----------------------------------------------------------------------------------------

def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in split(t)]
        n = min(width, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_copies(make, odd, words, width, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)  # several blocks a list
    rows = [x for x in odd if x[0] != 9] + planted(words)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(minhash.near_copies(make(rows), percent, width))]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(rows, width, percent)))
    kept = minhash.drop_near_copies(make(rows), percent, width)
    assert kept.columns == make(rows).columns
    assert {r["doc_id"] for r in rows_of(kept)} == {x[0] for x in brute_components(rows, width, percent) if x[3]}


def test_near_copies_where_hubs_fail(make, words):
    """A chain of texts: neighbours are similar, others are not."""
    w, rows = words(200, 1).split(), []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w[3 * i:3 * i + 3] = [f"n{i}a", f"n{i}b", f"n{i}c"]
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_copies(make(rows), 85, 3))}
    assert got == {i: c for i, _, c, _ in brute_components(rows, 3, 85)} and set(got.values()) == {0}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in rows_of(components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {x: find(x) for x in root}


# -- op 8 -----------------------------------------------------------------------------------------

def brute_lines(rows):
    docs = sorted({(math.inf if i is None else i, lines.tie_of((t or "").encode()), t) for i, t in rows}, key=lambda x: x[:2])
    seen, out = [], {}
    for i, _, t in docs:
        drop, raw = [], (t or "").encode().split(b"\n")
        for no, x in enumerate(raw):
            s = x.strip(b" \t\n\x0b\x0c\r").decode()
            if not s:
                continue
            w = s.encode("utf-32-le")
            if any(s == o or (len(s) >= 20 and len(o) >= 20 and abs(len(s) - len(o)) < 2 and lines.one_edit(w, v)) for o, v in seen):
                drop.append(no)
            seen.append((s, w))
        kept = b"\n".join(x for no, x in enumerate(raw) if no not in drop)
        out[i, t] = (len(raw), len(drop), hashlib.sha256(kept).hexdigest())
    return [(i, *out[math.inf if i is None else i, t]) for i, t in rows]


def test_lines(make, odd, words):
    rows = odd + planted(words)
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in rows_of(lines.remove_lines(make(rows)))]
    want = brute_lines(rows)
    assert sum(x[2] for x in want) > 35 and sorted(map(str, got)) == sorted(map(str, want))


# -- op 10 ----------------------------------------------------------------------------------------

def brute_hits(rows, items, n=10):
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        for a in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows[tuple(w[a:a + min(n, len(w))])].add(i)
    out = []
    for i, t in rows:
        w, hit, who = low(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if found := windows.get(tuple(w[a:a + k])):
                    hit.update(range(a, a + k))
                    who |= found
        out.append((i, len(w), len(hit), sorted(map(str, who)), bool(hit)))
    return out


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_decontamination(make, spark, odd, words, bound):
    items = [(1, words(35, 50)), (2, "Über Straße; X"), (3, None), (4, ""), (5, words(14, 101)), (6, "one-two"), (7, words(14, 101))]
    rows = odd + planted(words)
    got = decontaminate.decontaminate(make(rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=bound)
    found = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(map(str, r["items"])), r["contaminated"]) for r in rows_of(got)]
    want = brute_hits(rows, items)
    assert {len(x[3]) for x in want} >= {0, 1, 2} and sorted(map(str, found)) == sorted(map(str, want))
    kept = decontaminate.drop_contaminated(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    bad = {x[0] for x in want if x[4]}
    assert kept.columns == make(rows).columns and {r["doc_id"] for r in rows_of(kept)} == {i for i, _ in rows} - bad


# -- op 3 -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("head", [1 << 20, 40])
def test_lm(make, odd, words, head):
    rows = odd + planted(words)
    tok = lambda t: [x for x in (t or "").encode().lower().split()] + [b"\0"]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(x for i, t in rows if not out(i) for x in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(tok(t)), sum(c[x] > 0 for x in tok(t)), n,
                   sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok(t))) for i, t in rows)
    found = rows_of(lm.score_documents(make(rows), head_words=head))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])
    assert all(r["score"] <= 0 for r in found)
    # known sequences are likelier under the bigram model than word by word
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_lm_filter_grows_and_is_probed_by_a_join(make, odd, words, spark):
    rows = odd + planted(words)
    key = lambda r: tuple(map(str, r.values()))
    found = sorted(rows_of(lm.score_documents(make(rows), broadcast_bytes=1 << 40)), key=key)
    for head in (1 << 20, 40):
        joined = rows_of(lm.score_documents(make(rows), broadcast_bytes=0, head_words=head))
        assert len(joined) == len(found)
        by_id = lambda x: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 6), round(r["base_score"], 6)) for r in x)
        assert by_id(joined) == by_id(found)
    # bits follow the entries: five times the words, five times the filter, and it is as full as before
    sizes = []
    for n in (20, 100):
        train = spark.createDataFrame([(bytearray(words(2_000, 1_000 + i).encode()),) for i in range(n)], "text binary")
        bits = [np.frombuffer(bytes(r.bits), np.uint8) for r in lm.fit(train)[1].collect()]
        full = np.unpackbits(np.concatenate(bits)).mean()
        assert 0.1 < full < 0.2
        sizes.append(sum(map(len, bits)))
    assert sizes[1] > 4 * sizes[0]


def test_lm_blocks_follow_the_input(make, words, monkeypatch):
    rows = [(i, words(400, 2_000 + i)) for i in range(40)]
    whole = {r["doc_id"]: r for r in rows_of(lm.score_documents(make(rows)))}
    monkeypatch.setattr(lm, "BLOCKS", 4)
    monkeypatch.setattr(lm, "BLOCK_TEXT", 4_000)
    train = make(rows).selectExpr("cast(text as binary) as text")
    counts = [lm.fit(train.limit(n))[1].count() for n in (10, 40)]
    assert counts[0] > 4 and 3 * counts[0] < counts[1] < 5 * counts[0]
    found = rows_of(lm.score_documents(make(rows), broadcast_bytes=0))
    assert len(found) == len(whole)
    assert all(math.isclose(r["base_score"], whole[r["doc_id"]]["base_score"]) and r["n_known"] == whole[r["doc_id"]]["n_known"] for r in found)


def test_the_pipeline_searches_the_operators_paths(make, spark):
    found = rows_of(corpus_pipeline.encoding_stage(spark, make([(1, "the quick brown fox jumps over")]), ""))
    assert [len(r["nbest"]) for r in found] == [4]


# -- op 6, 7, 9, 1 --------------------------------------------------------------------------------

def brute_secrets(text):
    found = []
    for kind, pattern, ok in (
            (0, re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
            (1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (2, re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if ok(m)]
    return [f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_secrets(make, odd, spark, small):
    rows = odd + [(50, 'é ToKen : "abcdefgh" AKIA' + "Z9" * 9 + " " + "ab12" * 9), (51, 'X = "q8!Zr2#Lm5"\nsecret_key = X'), (52, "password=short, AKIAX")]
    docs = make(rows).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    own = Counter((r["doc_id"], tuple(brute_secrets(r["text"]))) for r in rows_of(docs))
    found = rows_of(secrets.find_secrets(docs))
    got = Counter((r["doc_id"], tuple(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in secrets.KINDS[:3])) for r in found)
    assert got == own
    assert any(s["kind"] == "constant" for r in found if r["doc_id"] == 51 for s in r["spans"])


def test_tokens(make, odd, tmp_path):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(q_documents.WORD_VOCABULARY)
    rows = [x for x in odd if x[0] != 4] + [(20, "a <|endoftext|> b")]
    folder = str(tmp_path / "tokens")
    files = tokens.write_tokens(make(rows), folder, q_documents.WORD_VOCABULARY, end_id=2, by_word=True)
    found = rows_of(tokens.read_tokens(make(rows).sparkSession, folder, files))
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    found.sort(key=lambda r: r["start"])
    assert [r["start"] for r in found] == np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(os.listdir(folder)) == [name for name, _ in files]


def test_pieces(make, odd):
    encoded = pieces.encode(make(odd), q_documents.PIECE_MODEL, n_best=3)
    found = rows_of(encoded)
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in odd) and all(r["round_trip"] for r in found)
    assert all(r["n_tokens"] == len(r["ids"]) == r["nbest"][0]["n_tokens"] for r in found)
    assert all(r["nbest"][0]["score"] == r["score"] and [p["score"] for p in r["nbest"]] == sorted((p["score"] for p in r["nbest"]), reverse=True) for r in found)
    back = Counter((r["doc_id"], r["text"]) for r in rows_of(pieces.decode(encoded, q_documents.PIECE_MODEL)))
    assert back == Counter((i, t or "") for i, t in odd)


def test_quality(make, odd, spark, words):
    good = [(1000 + i, words(80, 1000 + i)) for i in range(150)]
    bad = [(2000 + i, " ".join(x.upper() + "!!" for x in words(40, 2000 + i).split())) for i in range(60)]
    rows = odd + good + bad
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0), (99_999, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(make(rows), labels)
    found = rows_of(quality.score_quality(make(rows), model))
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] and r["doc_id"] >= 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and all((r["score"] >= 0.3) == (r["doc_id"] < 2000) for r in held)
    kept = quality.keep_quality(make(rows), model)
    assert kept.columns == make(rows).columns
    assert Counter(r["doc_id"] for r in rows_of(kept)) == Counter(r["doc_id"] for r in found if r["score"] >= 0.3)
    none = quality.fit_quality(make(rows), labels.limit(0))
    assert {r["score"] for r in rows_of(quality.score_quality(make(odd), none))} != set() and none.bias == 0.0


# -- empty tables ---------------------------------------------------------------------------------

def test_empty_tables(make, spark, tmp_path):
    docs = make([(1, "x")]).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    for out in (pieces.encode(docs, q_documents.PIECE_MODEL), substring.remove_repeats(docs), lm.score_documents(docs), exact.exact_copies(docs),
                exact.drop_copies(docs), minhash.near_copies(docs), secrets.find_secrets(docs), lines.remove_lines(docs),
                quality.score_quality(docs, model), decontaminate.decontaminate(docs, items)):
        assert out.count() == 0
    folder = str(tmp_path / "none")
    files = tokens.write_tokens(docs, folder, q_documents.WORD_VOCABULARY, end_id=2, by_word=True)
    assert tokens.read_tokens(spark, folder, files).count() == 0
    some = make([(1, "x"), (2, None)])
    assert [r["contaminated"] for r in rows_of(decontaminate.decontaminate(some, items))] == [False, False]


# -- registered queries ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(q_documents.ORACLES))
def test_query_matches_oracle(spark, con, small, name):
    got = q_documents.QUERIES[name](spark, small).toPandas()
    want = con.execute(q_documents.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values))


def test_pipeline_against_brute_force(spark, small):
    read = lambda t: rows_of(spark.read.parquet(f"{small}/{t}.parquet"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{small}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in rows_of(quality.score_quality(docs, model))}
    rows = [(r["doc_id"], r["text"]) for r in read("documents") if score[r["doc_id"]] >= 0.3]
    groups = {}
    for i, t in rows:
        k = SPACE.sub(b"", t.encode())
        groups[k] = min(groups.get(k, (0, i)), (-len(t), i))
    rows = [(i, t) for i, t in rows if groups[SPACE.sub(b"", t.encode())][1] == i]
    kept = {i for i, _, _, k in brute_components(rows, 5, 80) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    rows = [x for x, hit in zip(rows, brute_hits(rows, [(r["item_id"], r["text"]) for r in read("benchmark")])) if not hit[4]]
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "lang", "source", "n_chars", "ids"} <= set(out.columns)
    back = pieces.decode(out, q_documents.PIECE_MODEL)
    assert sorted((r["doc_id"], r["text"]) for r in rows_of(back)) == sorted(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] and len(rows) < docs.count()
