"""Near duplicates, language ID, quality, vector search and the pipeline against brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from alphaloom.llm import graph, language_id, near_dedup, quality, vector_search

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


# --- near duplicates ---

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_plainly(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_plainly(rows, k):
    sets = [sets_plainly(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return {d: min(low[find(i)]) for i, (d, _) in enumerate(rows)}, {d: len(s) for (d, _), s in zip(rows, sets, strict=True)}


def made_texts(n=120, seed=5):
    """Originals, copies with a few changed words, texts that share a long passage, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(5000))
    passage = [word() for _ in range(60)]
    texts = []
    for g in range(n // 12):
        base = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(4)]
    texts += ["", "  \n", "one", "One", "one two three", "ONE two\tthree", "É é", "é É"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(100 + i, texts[o]) for i, o in enumerate(order)]


@pytest.mark.parametrize("heavy", [near_dedup.HEAVY, 0])
def test_near_duplicates(spark, monkeypatch, heavy):
    monkeypatch.setattr(near_dedup, "HEAVY", heavy)
    rows = made_texts()
    want, size = components_plainly(rows, 4)
    got = near_dedup.near_duplicates(documents(spark, rows), near_dedup.MinMax(shingle=4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (size[r["doc_id"]], want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x", 1), (1, "a b c d e", "x", 1), (None, "a b c d e", None, 2), (4, None, "y", 3), (5, "", "y", 3)], "doc_id long, text string, bands string, n_shingles int")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 4, 5]


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n, out, new in ((5, 1, 0), (100, 7, 9), (1000, 300, 400), (20_000, 50, 0)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[out:], rng.integers(0, 2**63, new).astype(np.uint64)]))
        bits = int(np.bitwise_count((near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64)).sum())
        differ = len(np.setxor1d(a, b))
        assert bits <= differ and bits % 2 == differ % 2
        assert bits >= 0.6 * min(differ, 300)


def test_near_duplicates_of_a_whole_table(spark, monkeypatch):
    """op2 on all documents of sf0.01 against brute force, with and without the prefix filter; helper names clash."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    want, size = components_plainly([(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    for heavy in (near_dedup.HEAVY, 0):
        monkeypatch.setattr(near_dedup, "HEAVY", heavy)
        got = near_dedup.op2_minmax_dedup(spark, SF2).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (size[i], want[i], want[i] == i) for i in want}
    named = docs.limit(30).withColumns({"row": F.lit(1), "Group": F.lit("g"), "key": F.lit(2.0)})
    assert near_dedup.deduplicate(named).columns == named.columns


def test_a_very_long_text(spark):
    """Whole texts count: a change at the end of a long one is seen, a copy is found."""
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(5000)) for _ in range(60_000))
    rows = [(1, long), (2, long), (3, long + " new end"), (4, " ".join(reversed(long.split())))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_min_and_max_estimate_alike(spark):
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)]))
    signer = near_dedup.Signer(near_dedup.MinMax(permutations=2000, rows=4))
    same = signer.signature(a) == signer.signature(b)
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same[:2000].mean() - j) < 0.04 and abs(same[2000:].mean() - j) < 0.04


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language ID ---


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    train, rest = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0").withColumnRenamed("lang", "truth")
    found = language_id.identify(rest, language_id.fit(train), F.col("text"), F.col("source")).select("truth", "lang_found", "in_language").collect()
    assert sum(r["truth"] == r["lang_found"] for r in found) >= 0.98 * len(found)
    assert sum(r["in_language"] for r in found) >= 0.99 * len(found)


def test_noise_and_odd_rows_are_in_no_language(spark):
    rng = random.Random(1)
    model = language_id.fit(spark.read.parquet(f"{SF2}/documents.parquet"))
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=600)) for _ in range(5)]
    df = documents(spark, [*enumerate(noise), (10, None), (11, ""), (12, " \n "), (13, None)]).withColumn("posterior", F.lit("clash"))
    rows = language_id.identify(df, model, F.col("text"), F.lit(None).cast("string")).collect()
    assert len(rows) == 9 and all((r["lang_found"], r["in_language"]) == ("und", False) for r in rows)
    assert language_id.identify(df.limit(0), model, F.col("text"), F.col("source")).count() == 0
    nothing = language_id.fit(df.limit(0))
    assert [r["lang_found"] for r in language_id.identify(df.limit(1), nothing, F.col("text"), F.col("source")).collect()] == ["und"]


def test_clashing_columns(spark):
    """Documents may have columns with the names of the results; the pipeline keeps them, identify puts its own there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    plain = docs.withColumn("tag.x", F.lit(1))
    clash = plain.withColumns({"posterior": F.lit("clash"), "In_Language": F.lit(7), "lang_found": F.lit("xx")})
    kept = corpus_pipeline.keep_languages(spark, clash, SF)
    assert kept.columns == clash.columns
    rows = kept.collect()
    assert rows and {(r["posterior"], r["In_Language"], r["lang_found"]) for r in rows} == {("clash", 7, "xx")}
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs, SF).collect())
    for model in (language_id.fit(docs), language_id.fit(docs.limit(0))):
        found, want = (language_id.identify(df, model, F.col("text"), F.col("source")) for df in (clash, plain))
        assert found.columns == want.columns == [*plain.columns, "lang_found", "posterior", "in_language"]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_language_scores_by_hand(spark):
    """The fused posterior of every document against a plain computation: text, host, domain and corpus priors."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    model, spec = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet")), language_id.Fit()
    rows, k = docs.collect(), len(model.languages)
    logs, own = {}, {}
    for r in rows:
        mean, n = language_id.mean_ratios(model, r["text"])
        log = mean * (n / (1 + n / spec.full))
        p = np.exp(log - log.max())
        logs[r["doc_id"]], own[r["doc_id"]] = log, p / p.sum() if n and mean.max() >= spec.least else np.zeros(k)
    whole = sum(own.values())
    corpus = (whole + 1) / (whole.sum() + k)
    host, domain = defaultdict(lambda: np.zeros(k)), defaultdict(lambda: np.zeros(k))
    name = lambda h: ".".join(h.split(".")[-2:])
    for r in rows:
        host[r["source"]] += own[r["doc_id"]]
        domain[name(r["source"])] += own[r["doc_id"]]
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, F.col("text"), F.col("source")).collect()}
    for r in rows:
        mine = own[r["doc_id"]]
        smooth = lambda c, base: (np.maximum(c - mine, 0) + spec.smoothing * base) / (np.maximum(c - mine, 0).sum() + spec.smoothing)  # noqa: E731, B023
        z = logs[r["doc_id"]] + np.log(smooth(host[r["source"]], smooth(domain[name(r["source"])], corpus)))
        p = np.exp(z - z.max())
        p /= p.sum()
        found = got[r["doc_id"]]
        if mine.any():
            assert found["lang_found"] == model.languages[int(p.argmax())] and found["posterior"] == pytest.approx(p.max(), abs=1e-9)
            assert found["in_language"] == (p.max() >= spec.sure)
        else:
            assert (found["lang_found"], found["in_language"]) == ("und", False)


@pytest.mark.parametrize("evidence", ["host", "declared", "suffix"])
def test_each_evidence_turns_a_text_that_says_little(spark, evidence):
    """A text that two languages explain alike goes with its host, the declared language or the suffix, each by itself."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet").where("lang in ('fr', 'es') and length(text) > 800").select("text", "lang").collect()
    model = language_id.fit(spark.read.parquet(f"{SF2}/documents.parquet"))
    rows = [(r["text"], r["lang"], r["lang"] + ".x") for r in docs] + [("la de", lang, lang + ".x") for lang in ("fr", "es")]
    df = spark.createDataFrame(rows, "text string, lang string, site string")
    given = {"host": F.lit("one.site"), "declared": None, "suffix": None} | {evidence: F.col("site" if evidence == "host" else "lang")}
    found = language_id.identify(df, model, F.col("text"), given["host"], given["declared"], given["suffix"], language_id.Fit(least=-9)).where("text = 'la de'").collect()
    assert {r["lang"]: r["lang_found"] for r in found} == {"fr": "fr", "es": "es"}
    none = language_id.identify(df, model, F.col("text"), F.lit("one.site"), spec=language_id.Fit(least=-9)).where("text = 'la de'").collect()
    assert len({r["lang_found"] for r in none}) == 1


def test_evidence_decides_short_texts(spark):
    """The same ambiguous text goes with its host, and with what the markup declares."""
    model = language_id.fit(spark.read.parquet(f"{SF2}/documents.parquet"))
    long = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").where("lang in ('fr', 'es') and length(text) > 800").collect()}
    rows = [(f"{lang}.example", long[lang], lang) for lang in long for _ in range(6)] + [(f"{lang}.example", "la de", lang) for lang in long]
    df = spark.createDataFrame(rows, "host string, text string, declared string")
    found = language_id.identify(df, model, F.col("text"), F.col("host"), F.col("declared"), spec=language_id.Fit(least=-9)).where("text = 'la de'").collect()
    assert {r["declared"]: r["lang_found"] for r in found} == {"fr": "fr", "es": "es"}


def test_pages_language(spark):
    got = __spark_entry__.queries()["pages_language_id"](spark, SF2)
    declared = spark.read.parquet(f"{SF2}/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("declared"))
    rows = got.join(declared, "page_id").where("kept").collect()
    assert sum(r["lang"] == r["declared"] for r in rows) >= 0.9 * len(rows)


# --- quality ---


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


def test_quality_scores_by_hand(spark):
    """Every score of op5 from compressed sizes and the calibration's terms, put together anew."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    size = lambda d, t: len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False).compress(t))
    got = {r["doc_id"]: r for r in quality.op5_compression_quality(spark, SF).collect()}
    for r in docs.collect():
        t = (r["text"] or "").encode()
        good, bad, none, n = size(model.good, t), size(model.bad, t), size(b"", t), len(t) + 1
        raw = [(bad - good) / (bad + good), good / n, none / n, math.log(n), (none - good) / n, (none - bad) / n]
        terms = [*((v - m) / s for v, m, s in zip(raw, model.mean, model.scale, strict=True)), 1.0]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(terms, model.weights, strict=True))))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)


def test_held_out_rows(spark):
    ids = list(range(200))
    got = {r["doc_id"]: r["h"] for r in documents(spark, [(i, "x") for i in ids]).select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_quality_odd_rows(spark):
    docs = documents(spark, [(None, "some text"), (1, None), (2, ""), (2, "")]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, labels).collect()} == {0.5}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    texts = documents(spark, [(i, ("good words here " if i % 2 else "BAD!! ") * (3 + i)) for i in range(40)])
    model = quality.fit(texts, both)
    assert all(0 <= s <= 1 for s in quality.scores(model, [b"", b"x" * 300_000]))
    assert quality.classify(docs.limit(0), both).count() == 0


def test_long_texts_do_not_empty_the_samples(spark):
    """Texts beyond the bound are passed over, wherever they come in the order."""
    short = [(i, f"good words here number {i}" if i % 2 else f"BAD!! {i} " * 3) for i in range(60)]
    long = [(100 + i, "zq" * 5000) for i in range(60)]
    docs = documents(spark, short + long)
    spec = language_id.Fit(sample_bytes=4000)
    got, want = language_id.fit(docs, spec), language_id.fit(documents(spark, short), spec)
    assert got.languages == want.languages == ("en",) and (got.ratio == want.ratio).all()
    assert language_id.fit(documents(spark, long[:2]), spec).languages == ("en",)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in short + long], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels, quality.Fit(sample_bytes=8000)).weights


# --- vector search ---


def vectors(spark, rows):
    return vector_search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string"), "vec_id", "embedding")


def exact_plainly(ids, x, k, step):
    out = set()
    for i, q in enumerate(ids):
        if q % step == 0:
            order = sorted((-int(x[i] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
            out |= {(q, r, v, -s) for r, (s, v) in enumerate(order, 1)}
    return out


def test_exact_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (300, 40)).astype(float)  # small numbers: many ties
    x[50:80] = x[50]
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    v = vectors(spark, rows)
    for cells in (vector_search.Cells(), vector_search.Cells(rows=64, queries=4, dims=8)):
        got = {tuple(r) for r in vector_search.exact_top_k(v, F.col("id") % 20 == 0, 20, cells).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == exact_plainly(list(range(300)), x, 20, 20)


ODD = [(0, [1.0, 0.0], 0, "a"), (1, [0.5, 0.5], 0, "b"), (2, None, 0, "c"), (3, [1.0, None], 0, "d"), (4, [float("nan"), 1.0], 0, "e"), (5, [float("inf"), 1.0], 0, "f"), (6, [0.0, 0.0], 0, "g"), (None, [1.0, 1.0], 0, "h"), (7, [1.0, 0.0], 0, "i"), (7, [1.0, 0.0], 0, "i"), (8, [1.0, 2.0, 3.0], 0, "j"), (9, [], 0, "k")]


def test_vectors_odd_rows(spark):
    v = vectors(spark, ODD)
    got = vector_search.exact_top_k(v, F.col("id") % 20 == 0, 20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 7, 1), (2, 7, 1), (3, 1, 0), (4, 6, 0)]
    near = vector_search.approximate_top_k(v, F.col("id") % 50 == 0, 5).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(near, key=lambda r: r["rank"])] == [(1, 7), (2, 7), (3, 1)]
    for empty in (vector_search.exact_top_k(v.limit(0), F.col("id") % 20 == 0, 20), vector_search.approximate_top_k(v.limit(0), F.col("id") % 50 == 0, 5)):
        assert empty.count() == 0


def test_rows_of_one_id_find_each_other(spark):
    """Only a query's own row is left out, not other rows of its id."""
    v = vectors(spark, [(0, [1.0, 0.0], 0, "a"), (0, [0.9, 0.1], 0, "b"), (1, [0.0, 1.0], 0, "c")])
    for found in (vector_search.exact_top_k(v, F.col("id") % 20 == 0, 20), vector_search.approximate_top_k(v, F.col("id") % 50 == 0, 5)):
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]


@pytest.mark.parametrize("sf", [SF2, "/root/testdata/sf0.1"])
def test_approximate_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in vector_search.op8_adaptive_ann(spark, sf).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        close = unit @ unit[i]
        close[i] = -9
        best = set(ids[np.argsort(-close)[:5]])
        mine = got[ids[i]]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        for v, s in mine.values():
            assert abs(s - close[np.flatnonzero(ids == v)[0]]) < 1e-12
        hits, total = hits + len(best & {v for v, _ in mine.values()}), total + 5
    assert hits >= 0.9 * total


# --- the pipeline ---


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        if name == "MinHash near-dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want, _ = components_plainly(rows, 5)
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(want.values()))
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
        before = after
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id")
    kept = corpus_pipeline.keep_quality(spark, docs, SF).join(labels.where("quality = 1"), "doc_id")
    assert kept.count() >= 0.95 * good.count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = documents(spark, [(1, None), (2, ""), (None, "the and of to in"), (3, "the and of to in")])
    for at in ("documents", "labels"):
        (rows if at == "documents" else spark.createDataFrame([], "doc_id long, quality int, toxic int")).write.parquet(f"{tmp_path}/{at}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (rows, rows.limit(0)):
            assert stage(spark, df, str(tmp_path)).columns == rows.columns
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()  # null and empty texts go, of the two that repeat each other one stays at most
    assert len(left) <= 1 and {r["doc_id"] for r in left} <= {None, 3}
