"""Operators against brute force on small tables, with nulls, empties, ties, repeats and clashing columns."""

import collections
import gc
import hashlib
import time

import numpy as np
import pytest

from rasterfold.llm import ann, chat, exact_dedup, license_scan, ngram_join, packing, quality, sentencepiece_trie, sharding, toxicity
from rasterfold.llm.common import components, shingle_set
from rasterfold.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, n long, block long"
ROWS = [(1, "the quick brown fox jumps over the lazy dog again and again today", "en", 1, 1), (2, "The QUICK brown fox jumps over the lazy dog again and again today", "en", 1, 1), (3, None, None, 1, 1), (4, "", "x", 1, 1), (5, "one", "x", 1, 1), (6, "one", "x", 1, 1), (7, " \n\t ", "x", 1, 1), (8, "word " * 6000, "x", 1, 1), (9, "Released under the MIT License.", "en", 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_components(spark):
    got = {r["id"]: r["component"] for r in rows(components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "u long, v long")))}
    assert all(got[i] == 0 for i in range(41)) and got[100] == 99


def test_chat_keeps_maximal(spark):
    t = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (4, 5, "user", "z"), (5, 0, "user", "z"), (6, 0, None, None), (7, 0, "user", "b"), (7, 1, "assistant", "a")]
    got = {r["conv_id"]: r["text"] for r in rows(chat.format_chats(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")))}
    assert sorted(got) == [2, 4, 6, 7] and got[4] == "<|im_start|>user\nz<|im_end|>\n"
    long = spark.range(2500).selectExpr("1L conv_id", "id turn", "'user' role", "cast(id as string) text")
    parts = rows(chat.format_chats(long))
    assert len(parts) == 3 and "".join(r["text"] for r in sorted(parts, key=lambda r: r["part"])).count("<|im_end|>") == 2500
    assert not rows(chat.format_chats(long.limit(0)))


def test_chat_deals_out_by_position(spark):
    """Null and equal turn numbers, a null conversation, repeated rows and extra columns: positions and parts still follow the order."""
    n = 3000
    t = [(None, None, "u", f"{k % 700:04d}", 0, 0) for k in range(n)] + [(7, 5, None if k % 2 else "a", "same", 1, 1) for k in range(2100)] + [(8, 5, "", "same", 2, 2)] * 1050
    docs = spark.createDataFrame(t, "conv_id long, turn long, role string, text string, position long, chunk long")
    got = rows(chat.format_chats(docs))
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    for conv, want in ((None, [line("u", f"{k:04d}") for k in sorted(k % 700 for k in range(n))]), (7, [line("", "same")] * 1050 + [line("a", "same")] * 1050)):
        parts = sorted((r["part"], r["text"]) for r in got if r["conv_id"] == conv)
        assert [p for p, _ in parts] == [0, 1, 2] and "".join(x for _, x in parts) == "".join(want)
        assert parts[0][1] == "".join(want[: chat.CHUNK])
    assert not any(r["conv_id"] == 8 for r in got)  # a prefix of 7
    assert chat.placed(docs).groupBy("conv_id", "position").count().filter("count > 1").isEmpty()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    got = rows(packing.pack_documents(docs, path, 256, 1, keep_ids=True))
    encoder = Tokenizer.from_file(path)
    for d, text, *_ in ROWS:
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == encoder.encode(text or "", add_special_tokens=False).ids + [1]
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert not rows(packing.pack_documents(empty, path))


def test_packing_histogram_is_kept():
    h = {1: 5, 7: 30, 50: 11, 99: 4, 100: 2}
    got = collections.Counter()
    for config, times in packing.pack_histogram(h, 100):
        assert sum(k * v for k, v in config.items()) <= 100
        for k, v in config.items():
            got[k] += v * times
    assert got == h


def test_packing_program():
    rng = np.random.default_rng(4)
    for n in (500, 5000):
        h = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(np.exp(rng.normal(6, 1.2, n)).astype(int) + 1, 4096), return_counts=True))}
        program, greedy = {}, {}
        packing.pack_histogram(h, 4096, report=program)
        packing.pack_histogram(h, 4096, rounds=0, report=greedy)
        assert program["bound"] - 1e-6 <= program["sequences"] <= greedy["sequences"] and program["share"] > 0.9
        assert program["sequences"] <= program["bound"] * 1.005 + 1
    # 40 + 35 + 25 fit exactly, and no packing of these beats the tokens' own bound.
    report = {}
    packing.pack_histogram({40: 30, 35: 30, 25: 30}, 100, report=report)
    assert report["sequences"] == 30 and report["bound"] > 29.99


def test_search_against_brute_force(spark):
    x = np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32)
    x[10:20] = x[10]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [1.0] * 6), (904, [1.0])]
    got = collections.defaultdict(list)
    for r in sorted(rows(ann.search(spark.createDataFrame(table, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 20 == 0, 10)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    y = x.astype(float)
    for q in range(0, 600, 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len(set(want) & {v for v, _ in got[q]})
        assert all(abs(d[v] - s) < 1e-12 for v, s in got[q]) and len(got[q]) == 10
    assert hits / 300 >= 0.9 and sorted(got) == list(range(0, 600, 20))
    few = spark.createDataFrame(table[:4], "vec_id long, embedding array<float>")
    assert len(rows(ann.search(few, ann.F.col("vec_id") == 0, 10))) == 3 and not rows(ann.search(few.limit(0), ann.F.lit(True)))


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in rows(sentencepiece_trie.encode_documents(docs, path, keep_ids=True))}
    assert all(got[d]["ids"] == library.encode(t or "") and got[d]["round_trip"] for d, t, *_ in ROWS)
    assert not rows(sentencepiece_trie.encode_documents(empty, path))
    model = sentencepiece_trie.Model(path)
    texts = ["  two  marks\n", "éé 漢字 😀▁x", "aaaaaaaaaaaa", "internationalisation of tokenisers", " "]
    assert [np.frombuffer(r, "<u4").tolist() for r in model.encode_batch(texts, {})] == library.encode(texts)


def test_unigram_viterbi(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = 0.0 if p.type != 1 else -5 - (i * 7919 % 30011) / 4000 if "▁▁" not in p.piece else -90.0 - i
    (tmp_path / "u.model").write_bytes(proto.SerializeToString())
    model, library = sentencepiece_trie.Model(str(tmp_path / "u.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["the quick brown fox", "shared prefixes sharing share", "x"]
    assert [np.frombuffer(r, "<u4").tolist() for r in model.encode_batch(texts, {})] == library.encode(texts)


def test_exact_dedup(docs, empty):
    got = {r["doc_id"]: r for r in rows(exact_dedup.deduplicate(docs))}
    assert got[1]["keep_id"] == 2 and not got[1]["kept"] and got[2]["group_size"] == 2
    assert got[3]["keep_id"] == got[4]["keep_id"] == 4 and got[5]["keep_id"] == 6 and got[7]["kept"]
    assert got[9]["text_sha256"] == hashlib.sha256(b"released under the mit license.").hexdigest()
    assert not rows(exact_dedup.deduplicate(empty))


@pytest.mark.parametrize("n", [1, 2, 5, 100, 30_000])
def test_filters_hold_their_keys(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    f = exact_dedup.build_filter(np.unique(keys))
    assert exact_dedup.maybe_in(keys, *f).all()
    assert exact_dedup.maybe_in(np.random.default_rng(99).integers(0, 2**63, 50_000, dtype=np.uint64), *f).mean() < 0.02


def test_quality(spark, docs, empty):
    good = [(100 + i, "Plain words make a sentence here, number %d of many good ones." % i * 3, "en", 1, 1) for i in range(60)]
    bad = [(200 + i, "BUY!!! $$$ now### " * (3 + i % 5), "en", 1, 1) for i in range(60)]
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows(quality.score_quality(spark.createDataFrame(ROWS + good + bad, SCHEMA), labels))}
    held = [r for d, r in got.items() if r["held_out"] and d >= 100]
    assert held and sum((r["predicted"] == 1) == (r["doc_id"] < 200) for r in held) / len(held) > 0.9
    assert len({r["score"] for r in rows(quality.score_quality(docs, labels.limit(0)))}) == 1 and not rows(quality.score_quality(empty, labels))


def test_toxicity(spark, docs, empty):
    bad = [(300 + i, f"some plain text number {i} you idiot and moron", "en", 1, 1) for i in range(40)]
    good = [(400 + i, f"some plain text number {i} for reading", "en", 1, 1) for i in range(120)]
    labels = spark.createDataFrame([(r[0], 1, i % 2) for i, r in enumerate(bad)] + [(r[0], 0, 0) for r in good] + [(1, None, None)], "doc_id long, toxic int, other int")
    got = {r["doc_id"]: r["toxic"] for r in rows(toxicity.score_toxicity(spark.createDataFrame(ROWS + bad + good, SCHEMA), labels, ["other", "toxic"]))}
    assert all(got[r[0]] for r in bad) and not any(got[r[0]] for r in good) and not any(got[r[0]] for r in ROWS)
    assert not any(r["toxic"] for r in rows(toxicity.score_toxicity(docs, labels.limit(0), ["toxic"]))) and not rows(toxicity.score_toxicity(empty, labels, ["toxic"]))


def test_product_against_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64) << np.uint64(1)) for _ in range(12)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * f)], s[:0]])) for s in sets for f in (0.79, 0.8, 0.81, 1.0) if int(len(s) * f)] + [np.zeros(0, np.uint64)]
    values, ends = ngram_join.matrix([s.tobytes() for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = ngram_join.linked(values, ends, a, b, 80, 100)
    for i, j, g in zip(a.tolist(), b.tolist(), got.tolist()):
        x, y = set(sets[i].tolist()), set(sets[j].tolist())
        assert g == bool(x and y and 100 * len(x & y) >= 80 * len(x | y))


def test_ngram_join_on_a_cloud_of_near_copies(spark, monkeypatch):
    """Two clouds whose members mostly don't link with their centre, joined by one pair; small row blocks, so that several tiles are used."""
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", 40)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]

    def changed(words, places):
        return [f"x{rng.integers(10**9)}" if i in places else w for i, w in enumerate(words)]

    other = changed(base, {20, 60, 100})
    middle = [w if i in (20,) else v for i, (v, w) in enumerate(zip(base, other))]
    table = [(i, " ".join(changed(cloud, set(rng.choice(120, 2, replace=False).tolist())))) for i, cloud in enumerate([base] * 80 + [other] * 80)] + [(500, " ".join(middle))]
    links = []
    monkeypatch.setattr(ngram_join, "components", lambda e: links.append(e.count()) or components(e))
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.ngram_components(spark.createDataFrame(table, "doc_id long, text string"), 5, 80, 100))}
    sets = {d: set(shingle_set(t, 5).tolist()) for d, t in table}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {d: find(d) for d in sets} and max(links) <= 8 * len(table)


def test_ngram_join_drops_its_shuffle_files(spark, monkeypatch, docs):
    """Not only when the driver happens to collect its garbage; and the session's setting stays as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept, at_once = spark.conf.get(name), [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "release", lambda s: None)

    def shuffle_files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f.getName() for f in blocks.getAllFiles().mkString("\n").split("\n") and [spark._jvm.java.io.File(x) for x in blocks.getAllFiles().mkString("\n").split("\n")] if f.getName().startswith("shuffle_")}

    old = shuffle_files()

    def left(df):
        out, end = at_once(df), time.time() + 10 * (not any(kept))
        while shuffle_files() - old and time.time() < end:
            time.sleep(0.05)
        kept.append(len(shuffle_files() - old))
        return out

    monkeypatch.setattr(ngram_join, "cut", left)
    gc.disable()  # the driver's Python may hold the plans for as long as it likes
    try:
        ngram_join.ngram_components(docs, 5, 80, 100)
    finally:
        gc.enable()
    assert kept and not any(kept) and spark.conf.get(name) == before


def test_tiles_hold_each_row_of_a_small_group_once(spark, monkeypatch):
    """Rows 0 to 5 are one component, 6 to 8 stand alone. With row blocks of two rows, every pair with a row from 6 on still meets in one tile."""
    rows_ = spark.range(9).selectExpr("id doc_id", "10L n_shingles")
    labels = spark.range(6).selectExpr("id", "0L component")
    members = spark.range(9).selectExpr("7L block", "id doc_id")

    def tiles():
        out = collections.defaultdict(dict)
        for r in ngram_join._tiles(members, labels, rows_).collect():
            out[r["kind"], r["i"], r["j"]][r["doc_id"]] = r["side"]
        return out

    assert [sorted(t) for t in tiles().values()] == [list(range(9))]
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", 2)
    met = collections.Counter()
    for sides in tiles().values():
        met.update(tuple(sorted((x, y))) for x, s in sides.items() for y, t in sides.items() if s != 2 and t != 1 and (s or t == 2 or x < y))
    assert met == {(x, y): 1 for y in range(6, 9) for x in range(y)}


def test_ngram_join_on_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (9, b), (None, a), (None, b)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows(ngram_join.ngram_components(docs, 5, 80, 100))), key=repr)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (9, 3), (9, 3), (None, None), (None, None)], key=repr)


def test_quality_trees_node_by_node():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float))

    def walk(row):
        score = model["base"]
        for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"]):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            score += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-score))

    assert np.allclose(quality.predict(model, x), [walk(r) for r in x]) and ((quality.predict(model, x) > 0.5) == (x[:, 0] > 0)).mean() > 0.8


def test_chain_feeds_probabilities_of_other_folds():
    rng = np.random.default_rng(7)
    n, width = 200, 6
    hits = rng.random((n, width)) < 0.4
    at, cols = np.nonzero(hits)
    labels = np.column_stack([hits[:, 0], hits[:, 0] & hits[:, 1]]).astype(float)
    folds = np.arange(n) % toxicity.FOLDS
    allowed = np.ones((toxicity.FOLDS + 1, width), bool)
    allowed[:, 5] = False
    weights = toxicity.fit_chain(at, cols, labels, folds, allowed)
    assert [len(w) for w in weights] == [width + 1, width + 2] and all(abs(w[5]) < 1e-12 for w in weights)
    p = toxicity.chain_scores(weights, at, cols, n, width)
    first = 1 / (1 + np.exp(-(hits @ weights[0][:width] + weights[0][-1])))
    second = 1 / (1 + np.exp(-(hits @ weights[1][:width] + first * weights[1][width] + weights[1][-1])))
    assert np.allclose(p, np.column_stack([first, second])) and ((p > 0.5) == (labels > 0)).mean() > 0.97


def test_shards_of_every_column(spark):
    import zlib

    table = [(i, "w" * (i * 37 % 211)) for i in range(120)] + [(500 + i, "same text") for i in range(9)] + [(900, None), (901, "é")]
    got = {r["doc_id"]: r for r in rows(sharding.shard_documents(spark.createDataFrame(table, "doc_id long, text string"), 8))}
    by = collections.Counter()
    for d, t in table:
        raw = (t or "").encode()
        assert got[d]["size"] == len(raw) + 1 and got[d]["text_crc32"] == zlib.crc32(raw) and got[d]["law"] == "bytes" and got[d]["grown_shard"] is None
        by[got[d]["shard"]] += len(raw) + 1
    assert sorted(by) == list(range(8)) and max(by.values()) - min(by.values()) <= 4
    assert len({got[500 + i]["shard"] for i in range(9)}) == 1


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100)])
def test_ngram_join_against_brute_force(spark, docs, empty, size, num, den):
    rng = np.random.default_rng(size)
    base = [rng.choice(400, n).tolist() for n in (12, 25, 60, 300) for _ in range(4)]
    table = list(ROWS)
    for b in base:
        for k in range(9):
            w = list(b)
            for j in rng.choice(len(w), rng.integers(0, max(1, len(w) // 12) + 1), replace=False):
                w[j] = int(rng.integers(400, 9999))
            table.append((1000 + len(table), " ".join(f"w{x}" for x in w), "x", 1, 1))
    got = {r["doc_id"]: r for r in rows(ngram_join.ngram_components(spark.createDataFrame(table, SCHEMA), size, num, den))}
    sets = {d: set(shingle_set(t or "", size).tolist()) for d, t, *_ in table}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert all(got[d]["component_id"] == find(d) and got[d]["n_shingles"] == len(sets[d]) for d in sets)
    assert not rows(ngram_join.ngram_components(empty, size, num, den))


def test_shards(docs, empty):
    got = rows(sharding.shard_documents(docs, 4, chunk=2))
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert len(got) == len(ROWS) and shard[5] == shard[6] and shard[3] == shard[4]
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert not rows(sharding.shard_documents(empty))


def test_differencing_beats_dealing():
    sizes = np.random.default_rng(2).integers(1, 10_000, 300).tolist()
    bins, sums = sharding.difference([[s] + [0] * 7 for s in sizes])
    own = [0] * 8
    for s, b in zip(sizes, bins):
        own[b[0]] += s
    assert sorted(own) == sorted(sums) and max(sums) - min(sums) <= 20


def test_licenses(docs, empty, spark):
    got = rows(license_scan.scan_licenses(docs))
    assert [(r["doc_id"], r["license"], r["containment"], r["first_word"]) for r in got] == [(9, "mit", 1.0, 0)]
    deep = spark.createDataFrame([(1, "x " * 5000 + license_scan.TEMPLATES["isc"] + " y" * 77)], "doc_id long, text string")
    assert [(r["license"], r["first_word"]) for r in rows(license_scan.scan_licenses(deep))] == [("isc", 5000)]
    assert not rows(license_scan.scan_licenses(empty))


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on all that the one before kept: exactly the rows that its operator or a plain count marks go."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    toxic = {r["doc_id"] for r in rows(toxicity.score_toxicity(docs, corpus_pipeline.toxic_labels(spark.read.parquet(f"{folder}/labels.parquet")), corpus_pipeline.CATEGORIES)) if r["toxic"]}
    kept = corpus_pipeline.toxicity(spark, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows(kept)} == set(before) - toxic
    low = {r["doc_id"] for r in rows(quality.score_quality(kept, spark.read.parquet(f"{folder}/labels.parquet"))) if r["score"] < 0.5}
    good = corpus_pipeline.quality(spark, kept, folder)
    assert good.columns == docs.columns and {r["doc_id"] for r in rows(good)} == set(before) - toxic - low
    texts = collections.defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d in set(before) - toxic - low:
        texts[before[d].translate(lower)].append(d)
    once = corpus_pipeline.exact_dedup(spark, good, folder)
    alone = {max(ds) for ds in texts.values()}
    assert once.columns == docs.columns and {r["doc_id"] for r in rows(once)} == alone
    sets = {d: set(shingle_set(before[d], 5).tolist()) for d in alone}
    linked = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked[a].add(b)
                linked[b].add(a)
    left, first = set(sets), set()
    while left:
        reach, new = set(), {min(left)}
        while new:
            reach |= new
            new = {y for x in new for y in linked[x]} - reach
        first.add(min(reach))
        left -= reach
    far = corpus_pipeline.near_dedup(spark, once, folder)
    assert far.columns == docs.columns and {r["doc_id"] for r in rows(far)} == first
    places = collections.defaultdict(list)
    pieces = rows(corpus_pipeline.packing(spark, far, folder))
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in pieces} == first
    assert all(o == sum(n for p, n in own if p < o) for own in places.values() for o, _ in own) and all(sum(n for _, n in own) <= 4096 for own in places.values())


def test_pipeline_stages_on_nulls_and_empty_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, None, None, 7), (2, "", "x", 7), (3, "", "x", 7), (4, "one", "x", 7), (None, "one", "x", 7)], "doc_id long, text string, lang string, block long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns and not rows(stage(spark, docs.limit(0), folder)), name
    assert not rows(corpus_pipeline.packing(spark, docs.limit(0), folder))
