"""Byte-level BPE, ranked search and fill-in-middle against their libraries, definitions and brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from rasterfold.llm import bpe_replay, fim, lexical
from rasterfold.llm.queries import QUERIES, tokenizer_path

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, n long, terms string, block long"
TEXTS = [(1, "The quick brown fox's café, 12 naïve  crêpes\n\n"), (2, "ΑΒΓ 你好 😀😀 fox fox"), (3, None), (4, ""), (None, "fox and the café"), (6, "one"), (6, "one"), (7, " \n\t "), (8, "word 你 " * 4000), (9, "holds <M> fox"), (10, "a" * 3000), (11, "\x00\x1c\x85 fox")]
#: A null number sorts as this one.
LAST = np.iinfo(np.int64).max


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, 1, "x", 1) for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library(path):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_replay.Ranks(path).ranks, special_tokens={})


def expected(encoder, doc, text):
    ids = encoder.encode_ordinary(text or "")
    return doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_is_the_library(spark, docs, empty, monkeypatch):
    import public_tokenizers

    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path = tokenizer_path(name)
        got = bpe_replay.encode_documents(docs, path, public_tokenizers.PATTERN, keep_ids=True)
        encoder = library(path)
        want = collections.Counter(expected(encoder, d, t) for d, t in TEXTS)
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want
        back = bpe_replay.decode_documents(got, path).collect()
        assert collections.Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back) == collections.Counter((d, t or "") for d, t in TEXTS)
    assert not bpe_replay.encode_documents(empty, path, public_tokenizers.PATTERN).collect()


def test_byte_bpe_query(spark):
    encoder = library(tokenizer_path("byte_bpe_50k.tiktoken"))
    want = {expected(encoder, r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert {tuple(r) for r in QUERIES["op11_byte_bpe"](spark, DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_replay_of_small_texts_and_forgetting(monkeypatch):
    """Texts are let go often, words forgotten each time, long texts cut little by little."""
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(bpe_replay, "HELD_BYTES", 50)
    monkeypatch.setattr(bpe_replay, "KNOWN_BYTES", 0)
    monkeypatch.setattr(bpe_replay, "LONG", 20)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    batch = pa.record_batch({"doc_id": pa.array([d for d, _ in TEXTS], pa.int64()), "text": pa.array([t or "" for _, t in TEXTS])})
    got = [r for b in bpe_replay._encode(path, public_tokenizers.PATTERN, False)(iter([batch, batch])) for r in b.to_pylist()]
    encoder = library(path)
    assert [tuple(r.values()) for r in got] == 2 * [expected(encoder, d, t) for d, t in TEXTS]


def test_replay_mends_words_whose_ranks_fall(tmp_path):
    """A vocabulary in which a merge makes room for one of lower rank: the order of merges still is that of one word by itself."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"ca", b"abcab", b"bb"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    model, rng = bpe_replay.Ranks(str(path)), random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    ids, starts = model.replay(words)
    assert [ids[starts[k] : starts[k + 1]].tolist() for k in range(len(words))] == [model.alone(w) for w in words]
    assert model.replay([])[0].tolist() == []


def brute_search(docs, items, k):
    terms = {i: collections.Counter() for i, _ in items}
    for i, t in items:
        terms[i].update(lexical.terms_of(t or ""))
    counted = [(d, collections.Counter(lexical.terms_of(t or ""))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x for *_, x in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, wanted in terms.items():
        scores = []
        for d, c, length in counted:
            m = 75 + 25 * length * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, LAST if d is None else d))
        out += [(item, rank + 1, None if d == LAST else d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_search_is_brute_force(spark, docs, empty):
    items = [(1, "fox café THE quick"), (2, "word word one"), (3, None), (4, "nothing of it"), (1, "brown"), (None, "fox"), (5, "你好 ﾡ 12")]
    table = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, n long")
    for k, block in ((20, 8192), (1, 3), (2, 1)):
        got = lexical.search(docs, table, k, block)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_search(TEXTS, items, k)
    assert not lexical.search(empty, table).collect() and not lexical.search(docs, table.limit(0)).collect()


def test_search_without_broadcast(spark, monkeypatch):
    """Many ties, splits of large intervals, several groups of items, and a query set that counts as too large to broadcast."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [(d, " ".join(rng.choices(words, k=rng.choice([3, 3, 9, 40])))) for d in range(2500)] + [(5000 + d, "w1 w2 w3") for d in range(400)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(25)]
    d, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(texts, items, 20)
    assert sorted(map(tuple, lexical.search(d, i).collect()), key=repr) == want
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 8)
    assert sorted(map(tuple, lexical.search(d, i, 20, 700, 6).collect()), key=repr) == want


def test_intervals_leave_documents_out():
    """Bounds spare most documents: those scored are counted through the pops."""
    rng = np.random.default_rng(2)
    docs = [np.sort(rng.choice(100_000, 30_000, replace=False)).astype(np.int32) for _ in range(3)]
    impacts = [np.minimum(rng.pareto(1.0, 30_000) * 1000, 900_000).astype(np.int32) for _ in range(3)]
    block = lexical.Block(docs, impacts)
    taken = []
    whole = np.unique

    def counted(x, **more):
        taken.append(len(x))
        return whole(x, **more)

    lexical.np.unique, was = counted, np.unique
    try:
        got, scores = block.search(np.arange(3), np.array([3, 2, 1]), 20)
    finally:
        lexical.np.unique = was
    full = np.zeros(100_000, np.int64)
    for d, i, w in zip(docs, impacts, (3, 2, 1)):
        full[d] += i.astype(np.int64) * w
    want = np.lexsort((np.arange(100_000), -full))[:20]
    assert got.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert sum(taken) < 45_000


def test_fill_in_middle(docs, empty):
    got = [r.asDict() for r in fim.fill_in_middle(docs, keep_output=True).collect()]
    assert len(got) == len(TEXTS)
    texts = collections.defaultdict(list)
    for d, t in TEXTS:
        texts[d].append(t or "")
    forms = collections.Counter()
    for r in got:
        text = texts[r["doc_id"]][0]
        h = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        a, b, rate, spm = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(text)
        lo, hi = sorted((a % (n + 1), b % (n + 1)))
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or rate % 100 >= 90 else "spm" if spm % 100 < 20 else "psm"
        pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
        out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (r["n"], r["form"], r["output"]) == (n, form, out)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (lo, hi - lo))
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        forms[form] += 1
    assert forms["psm"] and forms["plain"]
    assert not fim.fill_in_middle(empty).collect()


def test_exceptions_index_every_character():
    text = "aé你😀 b" * 50 + "plain" + "😀"
    raw = text.encode()
    index = fim.Exceptions(np.frombuffer(raw, np.uint8))
    want = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.byte_of(np.arange(len(text) + 1)).tolist() == want.tolist()
    assert index.char_of(want).tolist() == list(range(len(text) + 1))
    assert len(index.at) == sum(ord(c) > 127 for c in text)


def test_fill_in_middle_restores_parts_that_end_in_a_piece_of_a_mark():
    for parts in ((b"x<", b"S>", b"<"), (b"<S", b">P>", b"<P"), (b"", b"", b""), (b"<<", b"M", b">")):
        for form in ("psm", "spm"):
            assert fim.restore(fim.join_parts(form, *parts), form) == b"".join(parts)


def test_fill_in_middle_of_small_spans(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "SPAN", 10)
    texts = ["", "é" * 30, "", "abc", "你好", "x", "", ""]
    batch = pa.record_batch({"doc_id": pa.array(range(8), pa.int64()), "text": pa.array(texts), **{f"h{k}": pa.array([7 * k + j for j in range(8)], pa.int64()) for k in (1, 2, 3, 4)}})
    got = [r for b in fim._transform(100, 50, True)(iter([batch, batch.slice(3)])) for r in b.to_pylist()]
    assert [r["n"] for r in got] == [len(t) for t in texts + texts[3:]]
    assert [r["restored_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in texts + texts[3:]]
    assert not [r for b in fim._transform(100, 50, True)(iter([batch.slice(0, 0)])) for r in b.to_pylist()]


def test_sql_of_the_new_queries(spark):
    import duckdb

    from rasterfold.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name in ("op12_lexical_search", "op13_fill_in_middle"):
        got = QUERIES[name](spark, DIR)
        rel = con.sql(ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_toxicity_scorer_is_its_inputs_summed(spark):
    """The scorer's own way to a text's marks against text_inputs, which the models are fitted on."""
    import pyarrow as pa

    from rasterfold.llm import toxicity

    rng = random.Random(4)
    words = [a + b for a in ("insul", "insula", "inspir", "plain", "x") for b in ("", "t", "ted", "tings", "ation")]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30]))).title() for _ in range(60)] + ["", "?!", "ÉCLAIR insult_insult"]
    every = sorted({h for t in texts for h in toxicity.text_inputs(t)})
    chosen = sorted(rng.sample(every, len(every) // 2))
    weights = [np.array([*np.linspace(-1, 1, len(chosen)), -0.2]), np.array([*np.linspace(0.5, -0.5, len(chosen)), 0.7, 0.1])]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    got = [r for b in toxicity._score(chosen, weights, ["a", "b"])(iter([batch])) for r in b.to_pylist()]
    for r, t in zip(got, texts):
        own = [chosen.index(h) for h in toxicity.text_inputs(t) if h in set(chosen)]
        p = 1 / (1 + np.exp(-(weights[0][own].sum() + weights[0][-1])))
        q = 1 / (1 + np.exp(-(weights[1][own].sum() + 0.7 * p + 0.1)))
        assert abs(r["p_a"] - p) < 1e-12 and abs(r["p_b"] - q) < 1e-12


def test_labels_that_repeat_count_as_the_greatest(spark):
    from rasterfold.llm import quality, toxicity

    docs = spark.createDataFrame([(k, ("vile scum " if k % 3 == 0 else "calm kind ") + "word " * (k % 5)) for k in range(120)], "doc_id long, text string")
    once = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    twice = once.unionByName(spark.createDataFrame([(k, 0) for k in range(120)] + [(5, None)], "doc_id long, toxic int"))
    score = lambda labels: sorted(map(tuple, toxicity.score_toxicity(docs, labels, ["toxic"], least=3.0).collect()))
    assert score(once) == score(twice)
    grade = lambda labels: sorted(map(tuple, quality.score_quality(docs, labels.withColumnRenamed("toxic", "quality")).collect()))
    assert grade(once) == grade(twice)


def test_words_are_remembered_in_two_generations():
    from rasterfold.llm.packing import Recent

    rng, r = random.Random(1), Recent(10_000)
    for _ in range(300):
        batch = {f"w{int(rng.expovariate(0.05))}" for _ in range(15)}
        new = r.missing(batch)
        r.fill(new, [w.encode() for w in new])
        assert all(r[w] == w.encode() for w in batch)
        assert r.size < 5_000 + 15 * 220 and len(r) + len(r.old) < 80


def test_toxicity_models_are_fitted_in_tasks(spark):
    """A chain over tasks gives the weights of a chain in one place, and only weights and sums come to the driver."""
    from rasterfold.llm import toxicity

    rng = np.random.default_rng(3)
    n, width = 300, 8
    hits = rng.random((n, width)) < 0.4
    hits[:5] = False
    at, cols = np.nonzero(hits)
    labels = np.column_stack([hits[:, 0], hits[:, 0] & hits[:, 1]]).astype(float)
    folds = np.arange(n) % toxicity.FOLDS
    allowed = rng.random((toxicity.FOLDS + 1, width)) < 0.8
    small = spark.createDataFrame([(d, int(labels[d, 0]), int(labels[d, 1]), int(folds[d]), np.flatnonzero(hits[d]).tolist()) for d in rng.permutation(n).tolist()], "doc_id long, y0 int, y1 int, fold int, cols array<int>").repartition(5)
    got, want = toxicity.fitted(small, 2, allowed), toxicity.fit_chain(at, cols, labels, folds, allowed)
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(got, want, strict=True))
    assert toxicity.fitted(small.limit(0), 2, allowed) == []


def test_toxicity_scorer_forgets_words(monkeypatch):
    from rasterfold.llm import toxicity

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 8))) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    chosen = sorted({h for t in texts[::2] for h in toxicity.text_inputs(t)})
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 20)
    marks = toxicity.Marks(chosen)
    for k in range(0, 60, 6):
        rows, cols = marks.inputs(texts[k : k + 6])
        assert sorted(zip(rows.tolist(), cols.tolist())) == sorted((i, chosen.index(h)) for i, t in enumerate(texts[k : k + 6]) for h in toxicity.text_inputs(t) if h in chosen)
        assert len(marks) <= 20 + 6 * 12
    assert [len(x) for x in marks.inputs([])] == [0, 0]


def test_packing_encodes_parts_as_one_text():
    """Parts that are one match of the tokenizer's pattern are encoded together, others by themselves, and the ids are the library's either way."""
    from tokenizers import Tokenizer

    from rasterfold.llm.packing import Words

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    odd = ["İstanbul", "ΟΔΟΣ", "été", "don't", "'s", "<|endoftext|>", "a<|endoftext|>b", "x1y22", "...", ".!!", "!!,word", "_a_", "", " ", " ", "日本語", "ñandú,", "Été?!", "ǅ", "ª", "\x85", "a‍b", "%%%", "st́.", "ﬁn"]
    plain = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "?!"]) for _ in range(400)]
    texts = [rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(plain + odd, k=rng.randint(0, 30))) for _ in range(300)]
    want = [np.array([*e.ids, 1], "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    words = Words(path, 1, 40_000)
    assert [x for k in range(0, 300, 30) for x in words.documents(texts[k : k + 30])] == want and len(words) < 425
    latin = [chr(c) for c in range(128, 0x250) if chr(c).isalpha()]
    both = [a + b for a in latin for b in rng.sample(latin, 3)] + [f"a{a}b" for a in latin]
    assert words.byte_level and words.documents(both) == [np.array([*e.ids, 1], "<u4").tobytes() for e in library.encode_batch_fast(both, add_special_tokens=False)]
    calm = ["stone", "été", ".", "?!"]
    calls = []
    words.encoded = lambda parts: calls.append(parts)
    assert words.joined(calm) == [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in calm] and not calls
    words.joined([*calm, "İ"])
    assert calls == [[*calm, "İ"]] and words.documents([]) == []
