"""Periodic runs, benchmark decontamination and embedding whitening against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import decontamination, periodic_runs, whitening
from alphaloom.llm.common import row_key

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- periodic runs ---


def runs_plainly(w, least=12):
    """(start, length, period) of all runs: equal stretches of every period, the smallest period of each stretch."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed_plainly(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def random_words(rng, n, kinds):
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            a, b = sorted((rng.randrange(n), rng.randrange(n)))
            p = 1 + rng.randrange(max(1, (b - a) // 2 + 1))
            for i in range(a, b):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least", [12, 2, 5])
def test_tiles_are_solved(least):
    rng = random.Random(least)
    for _ in range(150):
        parts = [random_words(rng, rng.choice([0, 1, 3, 12, 40, 150]), rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 5))]
        code = [np.array([int(x[1:]) for x in p], np.int64) for p in parts]
        for p, got in zip(parts, periodic_runs.solve(code, 1, 2**30, least), strict=True):
            assert sorted((a, b + q - a, q) for q, a, b in got.tolist()) == runs_plainly(p, least)


def test_fingerprints_are_checked(monkeypatch):
    """Where all blocks look alike the tile is solved by comparing words."""
    monkeypatch.setattr(periodic_runs, "mix64", lambda x: x * np.uint64(0))
    w = [1, 2, 3] * 6 + [4, 5]
    assert [(a, b + q - a, q) for q, a, b in periodic_runs.solve([np.array(w)], 1, 2**30, 12)[0].tolist()] == [(0, 18, 3)]


def test_runs_across_tiles(spark):
    """Tiles of 64 words: runs within, across and far longer than tiles, all scales, stitched."""
    rng = random.Random(3)
    docs = [random_words(rng, n, k) for n in (0, 11, 12, 63, 64, 65, 127, 130, 300, 700, 1500) for k in (1, 3, 500)]
    rows = [(str(i), w) for i, w in enumerate(docs)] + [("0", docs[0]), ("none", None), (str(len(docs) - 1), docs[-1])]
    found = periodic_runs.runs(spark.createDataFrame(rows, "key string, words array<string>"), periodic_runs.Tiles(tile=64, chunk=500)).collect()
    got = {}
    for r in found:
        got.setdefault(r["key"], []).append((r["start"], r["length"], r["period"]))
    for i, w in enumerate(docs):
        assert sorted(got.get(str(i), [])) == runs_plainly(w), (i, len(w))
    assert "none" not in got


def test_collapse_keeps_rows_and_columns(spark):
    line = "ab cd ef gh"
    rows = [(1, " ".join([line] * 5), "x"), (1, " ".join([line] * 5), "x"), (2, None, "y"), (3, "", "z"), (4, "one  two", None), (None, "tail " + "a " * 30, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __runs string")
    got = sorted(map(tuple, periodic_runs.collapse(docs).collect()), key=str)
    assert got == sorted([(1, line, "x"), (1, line, "x"), (2, None, "y"), (3, "", "z"), (4, "one  two", None), (None, "tail a", "w")], key=str)
    shuffled = periodic_runs.collapse(docs, periodic_runs.Tiles(broadcast=0))
    assert sorted(map(tuple, shuffled.collect()), key=str) == got
    assert periodic_runs.collapse(docs.limit(0)).count() == 0


def op11_plainly(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_plainly(w)
    best = min(((-length, s, q) for s, length, q in found), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *head, sha(lines), sha(" ".join(collapsed_plainly(w, found))))


def test_op11_whole_table(spark):
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    short = [r for r in rows if len((r[1] or "").split()) < 1500]  # brute force takes the square of the words
    assert len(short) > 0.9 * len(rows)
    for doc_id, text in short:
        assert got[doc_id] == op11_plainly(doc_id, text)
    assert sum(r[1] > 0 for r in got.values()) > 10


# --- benchmark decontamination ---


def words_plainly(text):
    lower = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def hits_plainly(text, items, k):
    w, inside, listed = words_plainly(text), set(), set()
    for item, own in items:
        v = words_plainly(own)
        for g in {tuple(v[i : i + k]) for i in range(max(1, len(v) - k + 1))} if v else ():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    inside |= set(range(i, i + len(g)))
                    if item is not None:
                        listed.add(str(item))
    return len(w), inside, sorted(listed)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again"), (2, "quick brown Fox!"), (10, "over the lazy dog again and again"), (3, ""), (4, None), (5, "--"), (2, "Überall É"), (None, "lazy dog")]
TEXTS = [
    "Say: the QUICK, brown fox jumps over the lazy dog again and again.", "quick brown", "", None, "überall é Überall É x", "a quick brown fox quick brown fox",
    "lazy dog lazy lazy dog", "..!!", "the quick brown fox jumps over the lazy dog  again", "\x00quick\x7fbrown\x00fox",
]


@pytest.mark.parametrize("broadcast", [1000, 0])
@pytest.mark.parametrize("k", [3, 10])
def test_contamination(spark, broadcast, k):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[5])], "doc_id long, text string").withColumn("key", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows, found = decontamination.contamination(docs, items, decontamination.Windows(words=k, broadcast=broadcast))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"] or 0, r["items"] or []) for r in rows.join(found, "key", "left").collect())
    want = []
    for i, t in [*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[5])]:
        n, inside, listed = hits_plainly(t, ITEMS, k)
        want.append((i is None, i or 0, n, len(inside), listed))
    assert got == sorted(want)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_spans_and_documents_are_removed(spark, broadcast):
    rows = [(1, "Keep this. The quick, brown FOX and more; ok.", "a"), (2, "nothing here", "b"), (3, None, "c"), (4, "quick brown fox", None), (4, "quick brown fox", None), (None, "", "d"), (6, "  fox! quick brown fox?\n", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __found string")
    items = spark.createDataFrame([(2, "quick brown fox")], "item_id long, text string")
    spec = decontamination.Windows(broadcast=broadcast)
    spans = sorted(map(tuple, decontamination.without_spans(docs, items, spec).collect()), key=str)
    assert spans == sorted([(1, "Keep this. The and more; ok.", "a"), (2, "nothing here", "b"), (3, None, "c"), (4, "", None), (4, "", None), (None, "", "d"), (6, "  fox?\n", "e")], key=str)
    assert sorted(r["text"] or "" for r in decontamination.without_documents(docs, items, spec).collect()) == ["", "", "nothing here"]
    assert decontamination.without_documents(docs, items, spec, most_hit=0.5).count() == 4
    assert decontamination.without_spans(docs, items.limit(0), spec).count() == 7
    assert decontamination.without_documents(docs.limit(0), items, spec).count() == 0


def test_op12_is_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = decontamination.op12_benchmark_decontamination(spark, SF)
    want = con.execute(decontamination.op12_sql())
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_row_key(spark):
    rows = [("1:2", "a"), ("1", "2:a"), (None, "a"), ("", "a"), ("1", None), ("1", "")]
    df = spark.createDataFrame(rows, "i string, t string")
    assert df.select(row_key(F.col("i"), F.col("t"))).distinct().count() == len(rows)


# --- embedding whitening ---


def whitened_plainly(x):
    """x-vectors -> mean, falling eigenvalues and eigenvectors of the distinct ones' covariance."""
    once = np.unique(x, axis=0)
    off = once - once.sum(0) / len(once)
    values, vectors = np.linalg.eigh(off.T @ off / len(once))
    return len(once), once.sum(0), values[::-1], vectors[:, ::-1]


def check_whitened(got, rows, k=4):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows])
    n, sums, values, vectors = whitened_plainly(x)
    k = min(k, x.shape[1])
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, found in by.items():
        found.sort(key=lambda r: r["vec_id"])
        order = np.argsort([i for i, _ in rows], kind="stable")
        want = ((x - sums / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1]))[order]
        have = np.array([r["whitened"] for r in found])
        have *= np.sign(have @ want)
        assert np.abs(have - want).max() < 1e-8
        assert {r["n"] for r in found} == {n}
        assert [r["deviation"] for r in found] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in order]
        assert all(abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in found)


def test_op13_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF2}/embeddings.parquet'").fetchall()
    check_whitened(whitening.op13_embedding_whitening(spark, SF2).collect(), rows)


def test_spectra_of_many_partitions_and_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 7)) * np.arange(1, 8))]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    check_whitened(whitening.whiten(df, spec=whitening.Whitening(together=2)).collect(), rows)


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, None), (2, [1.0, nan]), (3, [1.0, None]), (4, [inf, 0.0]), (5, []), (None, [0.5, -0.5]), (6, [0.5, -0.5]), (6, [0.25, 1.0]), (7, [-0.0, 2.0]), (8, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1))
    got = whitening.whiten(df).collect()
    two = [r for r in got if r["n"] == 3]
    assert len(two) == 8 and sum(r["vec_id"] is None for r in two) == 2
    one = [r for r in got if r["n"] == 1]  # a length of its own, without variance
    assert [(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(8, 1, 0, None, None, 0.0)]
    assert len(got) == 9
    assert whitening.whiten(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "d"), [(1, 3), (5, 3), (60, 20), (400, 16), (30, 1)])
def test_rank_one_updates(n, d):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(size=(n, d)) * np.linspace(1, 40, d)).astype(np.int64)
    if d > 4:
        x[:, 2], x[:, 3] = x[:, 4], 0  # deflated: a direction twice, and one without weight
    one, a, b = (whitening.Spectrum(d) for _ in range(3))
    for i, row in enumerate(x):
        one.add(row)
        (a if i % 3 else b).add(row)
    a.combine(b)
    off = x - x.mean(0)
    for s in (one, a):
        assert np.allclose((s.vectors * s.values) @ s.vectors.T, off.T @ off, atol=1e-9 * max(1, np.abs(off.T @ off).max()))
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(d), atol=1e-11)
        assert s.n == n and (s.sums == x.sum(0)).all()
