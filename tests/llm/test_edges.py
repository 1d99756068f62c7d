"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import bpe, jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, sharding, suffix_dedup, topk_search

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[(i * 7 + i // 5) % 24] + str(i % 97) for i in range(30_000))
BASE = " ".join(WORDS[(i * 5 + i // 3) % 24] + str(i) for i in range(120))
NEAR = BASE.replace("alpha0", "other", 1)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, "Licensed under the MIT license.\nword"), (None, BASE), (None, None), (9, "é" * 60 + BASE), (10, "Ünïcode ß 中文 <|endoftext|> 12"), (11, "a"), (12, "same same same " * 30),
]
# columns whose names the operators use inside
EXTRA = {"n": 1, "k": 2, "uid": 3, "score": 0.5, "rank": 1, "length": 7, "key": "x", "node": 4, "part": 0, "row_key": 5, "word": "w", "kept": True, "b": 1, "g": 2}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", "s" if (i or 0) % 2 else None, len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(13)] + [(None, 1), (1, None)], "doc_id long, quality int")


def rows(df):
    return [r.asDict() for r in df.collect()]


WORD_BPE = "word_bpe_49k.json"


def test_licenses(docs, none):
    model = license_scan.Model(["some other words here", "and nothing of the kind"])
    assert model.held_out_accuracy > 0.95
    got = rows(license_scan.license_scan(docs, model))
    assert [(r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in got] == [(8, 0, "MIT", True)]
    assert rows(license_scan.license_scan(none)) == []


def test_wrapped_notices_are_confirmed_once(spark):
    other = [" ".join(WORDS[(i * 5 + j) % 24] for j in range(9)) for i in range(40)]
    model = license_scan.Model(other)
    want, texts = [], []
    for family, templates in license_scan.TEMPLATES.items():
        for template in templates:
            for width in (24, 72, 75, 79):
                for mark in ("", " * ", "# "):
                    lines = textwrap.wrap(template, width, initial_indent=mark, subsequent_indent=mark)
                    k = len(texts)
                    want.append((k, 2, 1 + len(lines), family, True))
                    texts.append("\n".join([*other[k % 30 : k % 30 + 2], *lines, other[k % 37]]))
    one, two = license_scan.TEMPLATES["GPL-3.0"][1], license_scan.TEMPLATES["MIT"][2]
    n = len(textwrap.wrap(one, 78))
    want += [(len(texts), 0, n - 1, "GPL-3.0", True), (len(texts), n + 1, n + len(textwrap.wrap(two, 78)), "MIT", True)]
    texts.append(textwrap.fill(one, 78) + "\n\n" + textwrap.fill(two, 78))
    got = rows(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model))
    assert sorted((r["doc_id"], r["paragraph"], r["last_line"], r["family"], r["confirmed"]) for r in got) == want


def test_quality_rules(docs, none):
    got = rows(quality_rules.quality_rules(docs))
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    for i in (4, 5, 6, 11):
        assert by[i]["base_failed"] and not by[i]["kept"]
    assert by[6]["n_words"] == 0 and by[12]["n_repeat_words"] == 90 and by[12]["base_failed"] and by[1]["kept"]
    assert rows(quality_rules.quality_rules(none)) == []


def test_thresholds_move_smoothly_with_the_count(spark):
    def limit(n):
        of = lambda size, lang, source, x: spark.range(size).select(F.lit(lang).alias("lang"), F.lit(source).alias("source"), *[F.lit(x).alias(m) for m in quality_rules.METRICS])
        stats = of(n, "aa", "s", 0.5).union(of(3000, "aa", "t", 0.1)).union(of(3000, "bb", "t", 0.01))
        return {(r["lang"], r["source"]): r["max_symbol_rate"] for r in quality_rules.thresholds(stats).collect()}["aa", "s"]

    few, less, more, many = map(limit, (1, 199, 200, 20_000))
    assert few < less < more < many and more - less < 0.01 * (many - few) and more - few > 0.3 * (many - few)


def test_base_statistics_by_brute_force():
    text = "a b c d e f g h\n# a b c d e f g h $\nline\nline\n\n\n  \n"
    words = text.split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    cover = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            cover |= set(range(i, i + 8))
    assert quality_rules.base_statistics(text)[:5] == (len(words), sum(map(len, words)), 2, 1, len(cover))


def test_quality_classifier(docs, none, labels, spark):
    got = rows(quality_classifier.quality_scores(docs, labels))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len(rows(quality_classifier.quality_scores(docs, labels.limit(0)))) == len(TEXTS)
    assert rows(quality_classifier.quality_scores(none, labels)) == []


def test_languages(docs, none):
    got = rows(language_id.language_id(docs))
    assert len(got) == len(TEXTS)
    for r, t in ((r, dict((i, t) for i, t in TEXTS if i)) for r in got if r["doc_id"]):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t[r["doc_id"]] or ""))
    assert rows(language_id.language_id(none)) == []


def test_long_texts_have_the_n_grams_of_the_whole():
    text = " ".join(WORDS) * 40
    whole = sorted(language_id.grams([text])[0].tolist())
    old, language_id.CHUNK = language_id.CHUNK, 700
    try:
        parts = sorted(h for _, p, lead, cut in language_id._parts([text]) for h in language_id.grams(p, lead=lead, cut=cut)[0].tolist())
    finally:
        language_id.CHUNK = old
    assert whole == parts


def test_n_grams_over_a_real_cut():
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(1, 9, 5000)]
    text = " ".join(words[i] for i in rng.integers(0, 5000, 180_000))
    for size in (399_990, 400_010, len(text)):
        got = sum(len(language_id.grams(p, lead=lead, cut=cut)[0]) for _, p, lead, cut in language_id._parts([text[:size]]))
        assert got == len(language_id.grams([text[:size]])[0])


def test_n_grams_do_not_depend_on_length(spark):
    old, language_id.CHUNK = language_id.CHUNK, 50
    try:
        for text in ("我 是 人 " * 300, " ".join(WORDS) * 9, "我是人" * 200, "ab cd" + " 1" * 2500 + "e f g, " * 90, " a b" * 99, "7 " * 300 + "x", "ΑΣ ΣΑΣ İ ß " * 80, "word" * 40 + "..." * 300):
            want = sorted(language_id.grams([text])[0].tolist())
            got = [h for _, p, lead, cut in language_id._parts(["x y", text]) for h in language_id.grams(p, lead=lead, cut=cut)[0].tolist()]
            assert sorted(got) == sorted(want + language_id.grams(["x y"])[0].tolist())
    finally:
        language_id.CHUNK = old
    one = "我 是 人 "
    data = [(i, "a b c d " * 20, "aa") for i in range(20)] + [(100 + i, one * 20, "zh") for i in range(20)] + [(1000, one * 70_000, None)]
    got = rows(language_id.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string")))
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 100} == {"zh"}


def test_shards(docs, none):
    got = rows(sharding.shard_by_bytes(docs, 4))
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 16 for _, t in TEXTS)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert rows(sharding.shard_by_bytes(none)) == []


def test_shards_are_even_and_keep_groups(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1900).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("text"))
    hot = spark.range(2000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("the same text for all of these rows").alias("text"))
    got = sharding.shard_by_bytes(df.union(hot), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 0.03 * sizes.mean()
    cold = got[got.doc_id < 10_000]
    assert (cold.groupby("text_crc32").shard.nunique() > 1).sum() <= 10


@pytest.mark.parametrize("ranges", [2, 60])
def test_shards_are_even_whatever_the_sample(spark, monkeypatch, ranges):
    """A handful of sampled keys: overfull ranges, and hot texts that the sample missed, are found by measure."""
    monkeypatch.setattr(sharding, "SAMPLE_KEYS", 3)
    monkeypatch.setattr(sharding, "KEYS_A_RANGE", 0.05)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2500).cast("string")).alias("text"))
    hot = [spark.range(1000).select((F.col("id") + 10_000 * k).alias("doc_id"), F.lit(f"hot text {k}").alias("text")) for k in (1, 2)]
    got = sharding.shard_by_bytes(df.union(hot[0]).union(hot[1]), 10, ranges=ranges).toPandas()
    assert len(got) == got.doc_id.nunique() == 5000
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 0.03 * sizes.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def test_ranges_are_those_of_the_boundaries(spark):
    rng = np.random.default_rng(5)
    bounds = sorted({int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 300)} | {-(1 << 63), (1 << 63) - 1, 0, 1, 2})
    keys = [*bounds, *[b + 1 for b in bounds[:-1]], *[b - 1 for b in bounds[1:]], *map(int, rng.integers(-(1 << 63), (1 << 63) - 1, 300))]
    got = sharding._ranged(spark.createDataFrame([(k,) for k in keys], "g long"), bounds).collect()
    assert sorted((r["g"], r["rng"]) for r in got) == sorted((k, int(np.searchsorted(np.array(bounds), k, side="right"))) for k in keys)


def test_top_products(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(700, 8)).astype(np.float32)
    m[100:160] = m[7]
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    data += [(900, None), (950, [1.0, None]), (None, [1.0]), (1000, [float("nan")] * 8), (0, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))
    v = [(i, np.floor(256 * np.array(x, float))) for i, x in data if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    # the two rows of id 0 are two queries
    want = [(q, k + 1, i, -s) for q, a in v if q % 50 == 0 for k, (s, i) in enumerate(sorted((-int(a @ b), i) for i, b in v if i != q)[:5])]
    assert len([w for w in want if not w[0]]) == 10
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk_search.top_products(df))]
    assert sorted(got) == sorted(want)
    assert rows(topk_search.top_products(df.limit(0))) == []


def test_top_products_over_many_cells(spark, monkeypatch):
    """Chunks and blocks of a few rows, lengths that differ much, zero vectors, one vector very many times."""
    for name, value in {"HEAD": 16, "CHUNK_ROWS": 20, "QUERY_BLOCK": 4, "BLOCK": 8}.items():
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 5)) * np.exp(rng.normal(size=(400, 1)))
    m[100:240], m[300:320] = m[9], 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    v = np.floor(256 * m).astype(np.int64)
    want = [(q, k + 1, i, -s) for q in range(0, 400, 10) for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in range(400) if i != q)[:5])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk_search.top_products(df, every=10))]
    assert sorted(got) == sorted(want)


def test_codec(docs, none):
    path = public_tokenizers.path(WORD_BPE)
    tok = Tokenizer.from_file(path)
    got = rows(bpe.encode_and_decode(docs, path))
    want = []
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert rows(bpe.encode_and_decode(none, path)) == []


def test_transducer_streams_long_words():
    t = bpe.Transducer(public_tokenizers.path(WORD_BPE))
    word = ("abcab" * 900 + "xyz" * 400).encode()
    whole = t._merged([t.base[b] for b in word[:-1]] + [t.final[word[-1]]])
    assert list(t.stream(iter(word))) == whole


def test_near_duplicates(docs, none):
    got = rows(jaccard_join.near_duplicate_groups(docs))
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
    assert by == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 1, 10: 10, 11: 11, 12: 12}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert {r["n_shingles"] for r in got if r["doc_id"] in (4, 5, 6)} == {0}
    assert rows(jaccard_join.near_duplicate_groups(none)) == []


def test_pairs_lose_no_link_whatever_the_classes():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    linked = 0
    for top in (3, 8, 20):
        level = rng.integers(1, top, len(pool)).astype(np.uint8)

        def keys(t, n):
            of = level[np.searchsorted(pool, t)]
            order = np.lexsort((t, of))
            return jaccard_join.index_keys(t[order], of[order], n)

        for size in (1, 2, 3, 4, 5, 7, 8, 10, 15, 16, 31, 33, 48, 64, 75, 90, 130, 300, 1030):
            for _ in range(12):
                a = np.sort(rng.choice(pool, size, replace=False))
                b = np.sort(np.unique(np.concatenate((rng.choice(a, max(1, int(size * rng.uniform(0.8, 1))), replace=False), rng.choice(pool, rng.integers(0, 1 + size // 9))))))
                meet = np.intersect1d(a, b)
                # some of the tokens in one set alone belong to one node alone
                lone = lambda x: x[np.isin(x, meet) | (rng.random(len(x)) < 0.5)]
                if 5 * len(meet) >= 4 * (len(a) + len(b) - len(meet)):
                    linked += 1
                    assert np.intersect1d(keys(lone(a), len(a)), keys(lone(b), len(b))).size
                    apart = sum(int(x).bit_count() for x in (jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).view(np.uint64))
                    assert apart <= len(a) + len(b) - 2 * len(meet)
    assert linked > 150


def test_near_copies_by_brute_force(spark):
    """A cluster of near copies beyond the classes' bounds, shared passages, case and white space, ties of exactly 0.8."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    take = lambda n: [vocabulary[i] for i in rng.integers(0, 5000, n)]
    base, passage, texts = take(90), take(60), []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 4)):
            words[at] = f"x{i}"
        texts.append(" ".join(words).upper() if i % 7 == 0 else ("\t" if i % 5 == 0 else " ").join(words))
    for i in range(60):
        texts.append(" ".join(take(int(rng.integers(1, 40))) + passage + take(int(rng.integers(0, 60)))))
    for i in range(40):
        words = take(13)  # 9 shingles
        texts += [" ".join(words), " ".join([*words[:-1], "y"]), " ".join(words[:-1]), " ".join(words[:8]), " ".join(words[:3])]
    texts += ["one two", "One  TWO", "one two three"] * 40
    ids = rng.permutation(len(texts) * 3)[: len(texts)].tolist()
    sets = {}
    for i, t in zip(ids, texts):
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(ids)
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            meet = len(sets[a] & sets[b])
            if 100 * meet >= 80 * (len(sets[a]) + len(sets[b]) - meet) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = rows(jaccard_join.near_duplicate_groups(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(i, len(sets[i]), root(i)) for i in order]


def test_links_of_a_large_group_are_contracted(spark, monkeypatch):
    """The links of near copies grow with the square of their number; the edges that components are made of must not."""
    rng, copies, seen = np.random.default_rng(3), 400, []
    base, texts = [f"w{i}" for i in range(100)], []
    for i in range(copies):
        words = list(base)
        for at in rng.integers(0, 100, rng.integers(1, 3)):
            words[at] = f"x{i}"
        texts.append(" ".join(words))
    whole = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: (seen.append(edges.distinct().count()), whole(edges))[1])
    got = rows(jaccard_join.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert sum(seen) < 4.5 * copies
    sets = [{tuple(w[k : k + 5]) for k in range(96)} for w in map(str.split, texts)]
    name = list(range(copies))
    for a in range(copies):
        for b in range(a):
            if name[a] != name[b] and 100 * (meet := len(sets[a] & sets[b])) >= 80 * (192 - meet):
                name = [min(name[a], name[b]) if x in (name[a], name[b]) else x for x in name]
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == list(enumerate(name))


def exchanged(df):
    """Names of the columns of whole token lists that a plan sends through a shuffle."""
    todo, names = [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.initialPlan()
        if plan.nodeName() == "Exchange":
            names |= {o.name() for o in (plan.output().apply(i) for i in range(plan.output().size())) if o.dataType().simpleString() == "array<bigint>" and o.name() in ("tokens", "t_a", "t_b")}
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return names


def test_tokens_are_shuffled_for_pairs_alone(spark, monkeypatch):
    """Equal sets are told apart without a shuffle of their tokens, and a turn of few pairs reads the tokens of few nodes."""
    seen, whole = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (seen.append((name, exchanged(df))), whole(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        texts = [" ".join(f"w{i // 8}x{k}" for k in range(60)) + (" y" if i % 4 > 1 else "") for i in range(80)]
        texts = [t.upper() if i % 2 else t for i, t in enumerate(texts)]
        got = rows(jaccard_join.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)))
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i // 8 * 8) for i in range(80)]
        assert {name for name, columns in seen if columns} == {"jaccard-links"}
        held = [[i * 50 + k for k in range(50)] for i in range(4000)]
        nodes = whole(spark.createDataFrame([(i, 50, t) for i, t in enumerate(held)] + [(5000, 50, held[7]), (5001, 50, [-1, *held[8][1:]])], "node long, n int, tokens array<long>"), "nodes")
        sizes = []
        monkeypatch.setattr(jaccard_join, "written", lambda df, name: (sizes.append((name, df.count())), whole(df, name))[1])
        pairs = spark.createDataFrame([(7, 5000), (8, 5001), (9, 10)], "a long, b long")
        assert sorted(tuple(r) for r in jaccard_join._verified(pairs, nodes).collect()) == [(7, 5000), (8, 5001)]
        assert 6 <= dict(sizes)["jaccard-ends"] < 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_central_nodes_are_told_apart_in_large_groups(spark):
    """A node's tokens that very many others hold add up beyond a small float's range."""
    nodes = spark.createDataFrame([(i, 100, 100, list(range(100)), bytearray([16] * 90 + [9 + i] * 10)) for i in range(6)], "node long, n int, r int, tokens array<long>, classes binary")
    mid = {r["node"]: r["mid"] for r in jaccard_join._outlined(nodes).collect()}
    assert mid == {i: (90 * 2.0**16 + 10 * 2.0 ** (9 + i)) / 100 for i in range(6)}


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(packing.pack(docs, path))
    want = []
    for i, t in TEXTS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i or -1, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    for q in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == q), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert rows(packing.pack(none, path)) == []


def test_a_million_blanks_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "a" + "\n" * 700_000 + " b", "x" * 300_000):
        assert packing.encode(text, path) == tok.encode(text, add_special_tokens=False).ids
    got = rows(packing.pack(spark.createDataFrame([(1, " " * 1_000_000)], "doc_id long, text string"), path))
    assert sum(r["length"] for r in got) == 1_000_001


def test_completions_waste_least_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        pieces = sorted(rng.integers(1, 40, 9).tolist())
        counts = {n: pieces.count(n) for n in pieces}
        first, rest = pieces[-1], pieces[:-1]
        sums = {sum(x for i, x in enumerate(rest) if m >> i & 1) for m in range(1 << len(rest))}
        for room in (0, 7, 33, 90):
            for large in (True, False):
                got = packing.completion(packing.Shelf(counts), first, room, large)
                assert sum(got) == max(x for x in sums if x <= room) and all(got.count(n) <= rest.count(n) for n in got)


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(5):
        n, c = np.unique(np.minimum(rng.lognormal(5.5, 1, 3000).astype(int) + 1, 1024), return_counts=True)
        counts = {int(a): int(b) for a, b in zip(n, c)}
        p = packing.plan(counts)
        used: dict = {}
        for times, f in p:
            assert sum(f) <= 1024
            for x in f:
                used[x] = used.get(x, 0) + times
        assert used == counts and sum(t for t, _ in p) <= packing.lower_bound(counts) * 1.01 + 1


def test_plans_go_back_over_sequences():
    """As few sequences as brute force, whichever of them had to be filled otherwise."""

    def fewest(pieces, capacity):
        best = [len(pieces)]

        def put(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(pieces):
                best[0] = len(rooms)
                return
            for room in {r for r in rooms if r >= pieces[i]}:
                at = rooms.index(room)
                put(i + 1, [*rooms[:at], room - pieces[i], *rooms[at + 1 :]])
            put(i + 1, [*rooms, capacity - pieces[i]])

        put(0, [])
        return best[0]

    rng = np.random.default_rng(4)
    for _ in range(400):
        pieces = sorted(rng.integers(4, 26, 11).tolist(), reverse=True)
        counts = {n: pieces.count(n) for n in pieces}
        p = packing.plan(counts, 50)
        assert sorted(x for times, f in p for _ in range(times) for x in f) == sorted(pieces) and all(sum(f) <= 50 for _, f in p)
        assert sum(t for t, _ in p) == fewest(pieces, 50)


def test_incumbent_is_best_fit():
    # 6 goes beside 14, which leaves less room than 13
    assert sorted(f for _, f in packing.best_fit({14: 1, 13: 1, 6: 1}, 20)) == [[13], [14, 6]]
    assert sorted(packing.best_fit({7: 5}, 20)) == [(1, [7]), (2, [7, 7])]


def brute(texts):
    first, out = {}, {}
    for i, b in sorted(texts.items()):
        m = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                m[p] += 1
                m[p + 50] -= 1
        gone = np.cumsum(m[:-1]) > 0
        out[i] = (len(b), int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeated_passages(docs, none):
    got = rows(suffix_dedup.removal_digests(docs))
    want = brute({i: (t or "").encode() for i, t in TEXTS if i is not None})
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    assert len(got) == len(TEXTS)
    assert rows(suffix_dedup.removal_digests(none)) == []


def test_cut_documents_keep_their_replacement_characters(spark):
    passage = "".join(f"{w}{i} " for i, w in enumerate(WORDS * 3))[:200]
    # 語 is e8 aa 9e and 誠 e8 aa a0: the passage repeated goes on to the middle of a character
    data = [(1, passage + "語"), (2, "own \ufffd text " + passage + "誠 and \ufffd more"), (3, "whole \ufffd")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(corpus_pipeline.repeated_passage_stage(spark, df, ""))}
    assert got == {1: data[0][1], 2: "own \ufffd text  and \ufffd more", 3: "whole \ufffd"}
    # the rests of two characters at a cut don't make a third one
    assert suffix_dedup.decoded(["語".encode()[:2], "誠".encode()[2:] + b" x"]) == " x"


def test_loser_tree_never_loses():
    rng = np.random.default_rng(2)
    runs, every = [], []
    for _ in range(7):
        k = sorted(bytes(rng.integers(97, 99, 12, dtype=np.uint8)) for _ in range(int(rng.integers(0, 40))))
        m = np.frombuffer(b"".join(k), np.uint8).reshape(-1, 12)
        shared, rest = suffix_dedup.front_code(m)
        assert (suffix_dedup.front_decode(shared, rest, 12) == m).all()
        runs.append((k, shared.tolist()))
        every += k
    order, shared = suffix_dedup.merge_runs(runs, 12)
    out = [every[i] for i in order]
    assert out == sorted(every)
    for a, b, n in zip(out, out[1:], shared[1:]):
        assert n == next((i for i in range(12) if a[i] != b[i]), 12)


def test_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for at in (docs, none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == at.columns and out.count() <= at.count()
    kept = rows(corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 4, 5, 6, 7, 8, 10, 11, 12]
