"""Token counts, n-best segmentation, URL filters, PII and packing against brute force, libraries and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from alphaloom.llm import packing, pieces, pii, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

ODD = ["", " ", "  two  spaces ", "a\nb\t c", "naïve café ÈÉÇ", "日本語 テキスト 123", "emoji 😀 ok", "don't stop'll", "x" * 300, "THE QUICK BROWN", "a,b.c;d!e?f"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sample(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]


def unigram_tokenizer():
    """The same vocabulary in an independent implementation that works word by word with 64-bit scores."""
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return t


def unigram_sentencepiece():
    """The same file with its model type set to unigram."""
    import sentencepiece

    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_token_counts(spark):
    texts = [t for t in ODD + sample(spark) if "  " not in t]  # runs of spaces: see test_n_best
    reference = unigram_tokenizer()
    got = {r["doc_id"]: r for r in pieces.token_counts(documents(spark, texts), MODEL).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == (len(reference.encode(t, add_special_tokens=False).ids) if t else 0), t[:50]
        assert got[i]["n_chars"] == len(t)


def test_token_counts_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (5, None, 2), (5, None, 2), (6, "", 3)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, pieces.token_counts(df, MODEL).collect()), key=str) == sorted([(None, 3, 2), (5, 0, 0), (5, 0, 0), (6, 0, 0)], key=str)
    assert pieces.token_counts(df.limit(0), MODEL).count() == 0


def test_counts_and_encodings_agree(spark):
    encoder = pieces.Encoder(MODEL, 3)
    for t in ODD + sample(spark)[:10]:
        ids = np.frombuffer(encoder.encode(t)[0], "<u4").tolist()
        assert len(ids) == sum(map(encoder.vocabulary.count, encoder.vocabulary.split(t)))
        assert encoder.decode(ids) == t


def test_n_best():
    """Scores of the n best and the best ids, where 32-bit sums are still exact."""
    reference = unigram_sentencepiece()
    encoder = pieces.Encoder(MODEL, 4)
    for t in ["Hello world", "the cat sat on the mat", "thntedtion erhable", "a,b.c;d!e?f", "naïve café"]:
        ids, scores, changes = encoder.encode(t)
        best = reference.nbest_encode_as_ids(t, 4)
        score = lambda x: sum(reference.get_score(i) for i in x)
        assert scores == [score(x) for x in best]
        assert [score(x) for x in encoder.segmentations(t)] == scores
        assert np.frombuffer(ids, "<u4").tolist() == encoder.segmentations(t)[0] == best[0]
        assert len({tuple(x) for x in encoder.segmentations(t)}) == len(scores)
        assert all(reference.decode(x) == t for x in encoder.segmentations(t))
        assert changes[0] == []


def test_n_best_of_a_word_is_exhaustive():
    v = pieces.Vocabulary(MODEL)
    word = "▁thing"
    score = {}
    for i in range(len(word)):
        for _, (size, s, k) in v.matcher.iter(word[: i + 1]):
            score[word[i + 1 - size : i + 1]] = (s, k) if word[: i + 1].endswith(word[i + 1 - size : i + 1]) else None

    def ways(at):
        if at == len(word):
            yield 0.0, ()
        for end in range(at + 1, len(word) + 1):
            for _, (size, s, k) in v.matcher.iter(word[at:end]):
                if size == end - at:
                    yield from ((s + t, (k, *rest)) for t, rest in ways(end))

    every = sorted({ids: s for s, ids in ways(0)}.items(), key=lambda x: -x[1])
    found = v.n_best(word, 6)
    assert [s for s, _ in found] == [s for _, s in every[:6]]
    ids, s, loss = v.best_two(word)
    assert (s, loss) == (found[0][0], found[0][0] - found[1][0]) and ids == found[0][1]


def test_encode_and_decode_tables(spark):
    texts = [*ODD, None]
    encoded = pieces.encode(documents(spark, texts), MODEL, 2).selectExpr("doc_id", "segmentations[0] as ids", "scores")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, MODEL).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_digests_of_a_whole_table(spark):
    """op9 and op1 on every document of sf0.001: ids spelled out piece by piece, whole texts back, one count for both."""
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encoder = pieces.Encoder(MODEL, 4)
    counts = {r["doc_id"]: r["n_tokens"] for r in pieces.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = pieces.op9_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in rows} == set(docs) == set(counts)
    for r in rows:
        every = encoder.segmentations(docs[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(every[0], "<u4").tobytes()) and r["n_tokens"] == len(every[0]) == counts[r["doc_id"]]
        assert r["round_trip"] and len(r["scores"]) == len(every) and r["scores"] == sorted(r["scores"], reverse=True)
        assert len({tuple(x) for x in every}) == len(every)
        assert r["words_changed"][0] == 0


def test_encodings_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (5, None, 2), (5, None, 2), (6, "", 3), (7, "word " * 60_000, 4)], "doc_id long, text string, scores int")
    encoded = pieces.encode(df, MODEL, 3)
    got = sorted(((r["doc_id"], len(r["segmentations"]), len(r["segmentations"][0])) for r in encoded.collect()), key=str)
    assert [x for x in got if x[0] != 7] == sorted([(None, 3, 2), (5, 1, 0), (5, 1, 0), (6, 1, 0)], key=str)
    digest = pieces.encode_digest(df, MODEL, 3).collect()
    assert len(digest) == 5 and all(r["round_trip"] for r in digest)
    assert max(r["n_tokens"] for r in digest) >= 60_000
    for made in (pieces.encode(df.limit(0), MODEL), pieces.encode_digest(df.limit(0), MODEL), pieces.decode(df.limit(0).selectExpr("doc_id", "array(1) as ids", "text"), MODEL)):
        assert made.count() == 0
    assert [tuple(r) for r in pieces.decode(spark.createDataFrame([(None, None), (None, [])], "doc_id long, ids array<int>"), MODEL).collect()] == [(None, None), (None, "")]


# --- URL filters ---


def judged_plainly(url):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", tail, maxsplit=1)[0]
    path = re.split(r"[?#]", tail[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [
    None, "", "no scheme", "http://", "https://a.NET/x", "https://net/", "https://xnet/", "http://example.net/en/1", "http://m.example.net/en/", "http://example.net/de/", "http://example.com/de/a?b#c",
    "http://example.com", "http://a.org/fr/x", "http://a.org?x=/fr/", "http://a.org:80/fr/", "http://x.org/a/fr/", "ftp://h.com/a.exe", "http://h.com/ads/1", "http://h.com/q?sessionid=3", "http://evil.com/.net/", "http://b.net/" + "y" * 5000, "http://ünï.net/ö",
]


def test_url_filter(spark, tmp_path):
    random.seed(1)
    made = ["http://" + ".".join(random.choices(["net", "example", "org", "com", "a"], k=random.randint(1, 3))) + random.choice(["", "/", "/en/", "/de/x", "/fr/", "?q", "#f"]) for _ in range(200)]
    urls = URLS + made
    spark.createDataFrame([(i, u, "x", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in url_filter.op4_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, fit = judged_plainly(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        if fit:
            assert (got[i]["rule"], got[i]["verdict"]) == fit, u
        else:
            assert got[i]["rule"] is None
            assert got[i]["verdict"] == ("block" if got[i]["glob"] else "allow")


def test_host_rules_do_not_reach_into_the_query(spark, tmp_path):
    urls = ["http://a.com?u=b.net/x", "http://a.com?next=www.example.com/de/", "http://a.com?u=.org/fr/", "http://a.com?x.doubleclick.net/y", "http://a.net/?u=b", "http://b.net/x?u=a.org/fr/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["glob"]) for r in url_filter.op4_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(6)] == [(f := judged_plainly(u)[2]) and f[0] for u in urls] == [None, None, None, None, "net/", "net/"]
    assert [got[i][1] for i in range(3)] == ["allow"] * 3
    assert got[3] == (None, "block", "@.doubleclick.@/*")  # globs keep their [^/]*, as in the SQL
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        for page, _, _, rule, verdict, glob in db.execute(url_filter.op4_sql()).fetchall():
            assert got[page] == (rule, verdict, glob)


def test_globs_match_plainly():
    rules = [url_filter.Rule(g, g, "block", len(g)) for g in ("*.exe", "*/ads/*", "@.b.com/*", "abc", "*a*b*c*", "*" + "z" * 70 + "*")]
    machine = url_filter.Automaton(rules)
    assert machine.words > 1
    regex = {r.name: re.compile("".join(".*" if c == "*" else "[^/]*" if c == "@" else re.escape(c) for c in r.glob), re.S) for r in machine.rules}
    random.seed(2)
    urls = ["".join(random.choices("abc./exds", k=random.randint(0, 12))) for _ in range(3000)] + [".x.b.com/y", "q/ads/w", "abc", "f.exe", "-" + "z" * 71]
    won = machine.winners([u.encode() for u in urls])
    for u, k in zip(urls, won, strict=True):
        fits = [r.name for r in machine.rules if regex[r.name].fullmatch(u)]
        assert (machine.rules[k].name if k >= 0 else None) == (fits[0] if fits else None), u


def test_words_count_in_hosts_and_folders_only():
    machine = url_filter.Automaton(url_filter.glob_rules())
    assert machine.words > 40 and len(machine.rules) > 300
    urls = {".casino.com/": 1, ".best-casino.com/": 1, ".casino-win.com/": 1, ".my-casino-win.com/": 1, ".a.com/x/casino/y": 1, ".a.casino/": 0, ".mycasino.com/": 0, ".a.com/casino": 0, ".a.com?q=.casino.b": 0, ".a.com/?x=-casino-": 0, ".a-casino/": 1}
    won = machine.winners([u.encode() for u in urls])
    assert {u: int(k >= 0) for u, k in zip(urls, won, strict=True)} == urls


def test_url_filter_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(df, [url_filter.Rule("x", "*", "block", 1)]).count() == 0


# --- PII ---


def base_plainly(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_match_the_patterns():
    random.seed(3)
    texts = ["".join(random.choices("a@.-+ 12(%)9", k=random.randint(0, 40))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111 x", "a@b.c@d.e", "@@a@b..c", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8", "256.1.1.1", "é 10.0.0.1", "9" * 3000, "a" * 3000]
    for t in texts:
        got = pii.base_spans(t)
        assert [(k, *s) for k in pii.KINDS for s in got[k]] == base_plainly(t), t


def test_bootstrap_discovers_and_leaves_the_rest(spark):
    """Phones follow `call me`; a number that no base pattern takes is found there, but not elsewhere."""
    texts = [f"please call me +1 202 555 01{i:02d} soon" for i in range(8)] + ["please call me 555-0199 soon", "the room has 555-0188 seats", "see part 1234-77 now", None, ""]
    found = {r["doc_id"]: r for r in pii.find(documents(spark, texts)).collect()}
    assert found[8]["spans"] == "phone:15:23" and found[8]["base"] == "" and found[8]["n_phone"] == 0
    assert [found[i]["spans"] for i in (9, 10, 11, 12)] == [""] * 4
    redacted = {r["doc_id"]: r for r in pii.redact(documents(spark, texts)).collect()}
    assert redacted[8]["text"] == "please call me <phone> soon" and redacted[0]["text"] == "please call me <phone> soon"
    assert redacted[9]["text"] == texts[9] and redacted[11]["text"] is None and redacted[12]["text"] == ""
    assert redacted[8]["n_chars"] == len(redacted[8]["text"])


def test_instances_are_whole():
    """Spaced phones, cards of failing Luhn and spelled-out addresses are one instance each; sentences end runs."""

    def found(text):
        return [text[a:b] for kind, _, _, a, b in pii.instances(text, pii.base_spans(text)) if kind is None]

    assert found("please call me (555) 123-4567 soon") == ["(555) 123-4567"]
    assert found("call 555 123 4567, or 555.987.6543. 12 came") == ["555 123 4567", "555.987.6543"]
    assert found("card (4111 1111 1111 1112) ends") == ["4111 1111 1111 1112"]
    assert found("ask jane at example dot com or Jo dot Doe [at] mail [dot] example [dot] org.") == ["jane at example dot com", "Jo dot Doe [at] mail [dot] example [dot] org"]
    assert found("ask jane @ example.com, @handle.name, look at it, at 3.5 or at jane.doe@example.com") == ["jane @ example.com", "@handle.name"]
    assert found("id ab-12 34 of 99") == ["ab-12"]
    assert found("see 10.0.0.1 4567 89") == ["4567 89"]
    assert pii.contexts("Tel 12 +1 202", 7, 13) == ["1:00", "2:tel 00"] and pii.contexts("x so far", 0, 1) == ["3:so", "4:so far"]


def test_bootstrap_discovers_identifiers_of_several_tokens(spark):
    seeds = [f"please call me +1 202 555 01{i:02d} soon" for i in range(8)]
    seeds += [f"please write to user{i}@example.com today" for i in range(8)]
    seeds += [f"charge my card 4111 1111 1111 {n} now" for n in ("1111", "1129", "1137", "1145", "1152", "1160") if pii.luhn(f"411111111111{n}")] + ["charge my card 5500 0000 0000 0004 now", "charge my card 3400 0000 0000 009 now"]
    assert sum(len(pii.base_spans(t)["card"]) for t in seeds) >= 4
    odd = {
        "please call me (555) 123-4567 soon": "please call me <phone> soon",
        "please call me 555 123 4567 soon": "please call me <phone> soon",
        "charge my card 4111 1111 1111 1112 now": "charge my card <card> now",
        "please write to jane at example dot com today": "please write to <email> today",
        "me 555 123 9999 there": "me <phone> there",  # one word before
        "555 321 4567 soon": "<phone> soon",  # only what follows
        "the hall has 555 123 4567 seats": "the hall has 555 123 4567 seats",
    }
    docs = documents(spark, [*seeds, *odd])
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for i, (text, want) in enumerate(odd.items(), len(seeds)):
        assert redacted[i] == want
        marked = text
        for k, a, b in reversed([x.split(":") for x in spans[i].split(",") if x]):
            marked = marked[: int(a)] + f"<{k}>" + marked[int(b) :]
        assert marked == want


def test_redaction_by_join(spark, monkeypatch):
    texts = [f"please call me +1 202 555 01{i:02d} soon" for i in range(8)] + ["please call me 555-0199 soon", "nothing"]
    plain = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()}
    monkeypatch.setattr(pii, "MOST_PATTERNS", -1)
    assert {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()} == plain


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in pii.op6_bootstrapped_pii(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        base = base_plainly(r["text"] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        n = Counter(k for k, *_ in base)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]) == tuple(n[k] for k in pii.KINDS)
        assert set(text.split(",")) <= set(g["spans"].split(",")) | {""}


def test_pii_of_nothing(spark):
    assert pii.find(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0


# --- packing ---


def ids_plainly(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in docs.items():
        ids = ids_plainly(text)
        cut = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k, k * capacity, len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for k, p in enumerate(cut)]
    return len(by_sequence)


def test_packing(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op10_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, docs, 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert n <= least * 1.03 + 1


def test_packing_odd_rows(spark):
    texts = [None, "", "hi", "<|endoftext|> odd <|start", *ODD]
    spec = packing.Packing(WORDS, capacity=16)
    rows = packing.pack(documents(spark, texts), spec).collect()
    check_packing(rows, dict(enumerate(texts)), 16)
    assert packing.pack(documents(spark, []), spec).count() == 0
    twice = packing.pack(documents(spark, ["same words here", "same words here"], [7, 7]), spec).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
    assert len(packing.pack(documents(spark, ["x"], [None]), spec).collect()) == 1


def test_word_ids_by_batches():
    texts = [None, "", "two  spaces\nand a line", "it's <|endoftext|>glued", "x" * 500, "x" * 500 + " again", "naïve 中文 12345 a1b2", " ", *ODD]
    words = packing.WordIds(WORDS, remembered=8)
    for a in (0, 1, 3):
        batch = pa.array(texts, pa.string()).slice(a)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(batch)] == [ids_plainly(t)[:-1] for t in texts[a:]]
    assert words.encode(pa.array([], pa.string())) == [] and words.encode(pa.array([None, None], pa.string())) == [b"", b""]
    assert not any(len(w) > 64 for w in [*words.recent, *words.older])


def test_packing_in_the_pipeline(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts = [None, "", *ODD, *docs]
    check_packing(corpus_pipeline.pack_sequences(spark, documents(spark, texts), SF).collect(), dict(enumerate(texts)), 2048)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    random.seed(seed)
    spec = packing.Packing(WORDS, capacity=100, groups=(8, 100))
    lengths = random.choices(range(1, 101), weights=[random.random() ** 3 for _ in range(100)], k=3000)
    histogram = dict(Counter(lengths))
    plan = packing.best_plan(histogram, spec)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, lo, hi, first, each, offset in plan.rows:
        for rank in range(lo, hi):
            assert rank not in ranks[length]
            ranks[length].add(rank)
            used[first + (rank - lo) // each].append((offset + (rank - lo) % each * length, length))
    assert {k: len(v) for k, v in ranks.items()} == histogram and all(v == set(range(len(v))) for v in ranks.values())
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert plan.sequences <= best_fit(lengths, 100) * 1.01 + 1


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(capacity - n)
    return len(free)
