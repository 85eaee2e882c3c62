"""Personal data: base patterns of fixed form, then bootstrapped contextual extraction.

What the base patterns find are seeds. Every number-like or address-like stretch of the corpus is an instance: a token
with a digit or an at sign, a run of several tokens of digits and punctuation, an address with its signs spelled out. The
one and two words before it and the one and two words after it are its lexical patterns. Patterns and instances form a
graph, which Spark scores in turn: a pattern is
as good for a kind as the share of its different instances that belong to that kind, an instance as good as the patterns
that bring it up. Patterns that end up with high confidence and enough different seeds discover identifiers that no
base pattern fits; a pattern that appears before anything does not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, table, text_batches, trim, unused, utf8

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# A match never starts inside a run of digits that another start reaches first, so looking back changes no result and
# keeps long runs from being read again from each of their characters.
_DOMAIN, _LOCAL = re.compile(DOMAIN), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP, _CARD, _PHONE = re.compile(r"(?<![0-9])" + IP), re.compile(CARD), re.compile(PHONE)
#: What can be an instance: a token with a digit or an at sign. What makes up its contexts: words before and after it.
_TOKEN = re.compile(r"(?<!\S)[^\s@]*[0-9@]\S*")
_EDGE = ".,;:!?\"'()[]{}<>"
#: Tokens that make up a run, as in base phones and cards, and what may stand between two of them: no end of a sentence.
_NUMBER, _GAP = re.compile(r"\+?[0-9().-]+"), re.compile(r"(?!.*\.\s)[\x20\t\xa0().-]{1,8}")
#: A spelled-out address: `at` or a spaced at sign, a domain with spelled or plain dots, and the local part before it.
_DOT = r"(?:\.|\s{1,3}dot\s{1,3}|\s{0,3}[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s{0,3})"
_AT = re.compile(r"(?<=[\s(\[{<])at(?=[\s)\]}>])|@", re.IGNORECASE)
_TAIL = re.compile(rf"\s?[)\]}}>]?\s{{0,3}}([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9@-])", re.IGNORECASE)
_HEAD = re.compile(rf"[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9._%+-]+)*(?=\s{{0,3}}[(\[{{<]?\s?$)", re.IGNORECASE)
#: Characters before and after an instance in which its context words are looked for, and those of a local part.
REACH, LOCAL_REACH = 80, 320


@dataclass(frozen=True)
class Bootstrap:
    """rounds: of scoring. confident: what a pattern must score. seeds: different base instances it must have.

    prior: instances of no kind that every pattern is taken to have.
    """

    rounds: int = 3
    confident: float = 0.6
    seeds: int = 3
    prior: float = 1.0


def emails(text: str) -> list[tuple[int, int]]:
    """The spans of the base e-mail pattern: for each at sign the run of local characters before it, then a domain."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """kind -> spans in code points, end exclusive; matches that fail their check are dropped, without another try."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a place: the last one and two words before it, `1:` and `2:`, the first ones after it, `3:` and `4:`.

    Lower-cased, digits as 0; none of two words where there is one.
    """
    before = text[max(0, start - REACH) : start].lower().split()
    if start > REACH and before and not text[start - REACH - 1].isspace():
        before = before[1:]  # its beginning may be cut off
    after = text[end : end + REACH].lower().split()
    if end + REACH < len(text) and after and not text[end + REACH].isspace():
        after = after[:-1]
    before, after = ([re.sub(r"[0-9]", "0", w) for w in words if "@" not in w] for words in (before, after))
    found = [(1, before[-1:]), (2, before[-2:]), (3, after[:1]), (4, after[:2])]
    return [f"{form}:{' '.join(words)}" for form, words in found if len(words) == 2 - form % 2]


def spelled(text: str) -> list[tuple[int, int]]:
    """The spans of addresses as in `jane at example dot com` or `jane (at) example.com`, that no base pattern takes."""
    out, last = [], 0
    for at in _AT.finditer(text):
        tail = _TAIL.match(text, at.end())
        if not tail or at.start() < last or tail[1].lower().startswith("www."):
            continue
        bare = at[0] == "@" and text[at.start() - 1 : at.start()] not in ("(", "[", "{", "<")
        if bare and text[at.start() - 1 : at.start()].isspace() != text[at.end()].isspace():
            continue  # a handle
        low = max(last, at.start() - LOCAL_REACH)
        if head := _HEAD.search(text[low : at.start()]):
            out.append((low + head.start(), tail.end()))
            last = tail.end()
    return out


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(text: str, busy: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign, without the marks around them, that meet nothing busy; numbers in one run."""
    out: list[tuple[int, int]] = []
    i, open_ = 0, False  # open_: whether the last span may be carried on
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if a == b or i < len(busy) and busy[i][0] < b:
            open_ = False
            continue
        number = _NUMBER.fullmatch(text, a, b) is not None
        if open_ and number and text[a] != "+" and a - out[-1][1] <= 8 and _GAP.fullmatch(text[out[-1][1] : a]):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        open_ = number
    return out


def _bracketed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span with the bracket just outside it that belongs to one within it, as in (555) 123-4567."""
    more = text.count("(", a, b) - text.count(")", a, b)
    if more < 0 and text[a - 1 : a] == "(":
        return a - 1, b
    return (a, b + 1) if more > 0 and text[b : b + 1] == ")" else (a, b)


def instances(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str | None, list[str], str, int, int]]:
    """(kind or None, contexts, instance, start, end) of base spans and of what else looks like an identifier.

    Runs of fewer than four characters are none.
    """
    out = [(k, c, text[a:b].lower(), a, b) for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]) if (c := contexts(text, a, b))]
    busy = _disjoint([s for k in KINDS for s in spans[k]])
    written = [(a, b) for a, b in spelled(text) if not any(x < b and y > a for x, y in busy)]
    runs = [_bracketed(text, a, b) for a, b in _runs(text, _disjoint(busy + written))]
    for a, b in sorted(written + [(a, b) for a, b in runs if b - a >= 4]):
        if c := contexts(text, a, b):
            out.append((None, c, text[a:b].lower(), a, b))
    return out


_PASS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<kind:string,contexts:array<string>,instance:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("contexts", pa.list_(pa.string())), ("instance", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _first_pass(batches):
    release()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            text = text.decode() if text else ""
            spans = base_spans(text)
            found = [dict(zip(("kind", "contexts", "instance", "start", "end"), x, strict=True)) for x in instances(text, spans)]
            rows.append((doc_id, *(len(spans[k]) for k in KINDS), joined(spans), found))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.string(), _FOUND]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])
    trim()


def confident_patterns(found: DataFrame, spec: Bootstrap) -> DataFrame:
    """found (kind, context, instance) -> (context, kind, doubt): the patterns to trust, doubt being less for trust.

    Edges are distinct and carry no counts, so an identifier that is repeated a million times weighs once.
    """
    edges = stored(found.groupBy("context", "instance").agg(F.max("kind").alias("seed")))
    sizes = edges.groupBy("context").agg(F.count("*").alias("n"), F.count("seed").alias("n_seed")).where(f"n_seed >= {spec.seeds} and n > n_seed")
    useful = stored(edges.join(sizes, "context").select("context", "instance", "seed", "n"))
    seeds = useful.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    belief, trust = seeds, None
    for _ in range(spec.rounds):
        scored = useful.join(belief, "instance").groupBy("context", "kind").agg((F.sum("belief") / (F.first("n") + spec.prior)).alias("trust"), F.count("seed").alias("n_seed"))
        trust = stored(scored.where(f"n_seed >= {spec.seeds}").select("context", "kind", "trust"))
        # An instance of no kind yet: what the patterns that bring it up do not leave open.
        # The forms of a pattern see the same places, so the best form counts, not all of them.
        raised = useful.where("seed is null").join(trust, "context").groupBy("instance", "kind", F.substring("context", 1, 1).alias("form"))
        by_form = raised.agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))).alias("belief"))
        grown = by_form.groupBy("instance", "kind").agg(F.max("belief").alias("belief"))
        belief = seeds.unionByName(grown)
    return trust.where(F.col("trust") >= spec.confident).select("context", "kind", (1 - F.col("trust")).alias("doubt"))


def _best_kind() -> Column:
    """Of several patterns the kind of the most trusted one, ties to the first by name."""
    return F.min(F.struct("doubt", "kind"))


def find(docs: DataFrame, spec: Bootstrap = Bootstrap()) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row: doc_id, n_email, n_ip, n_card, n_phone, base, spans.

    The counts and base are of base spans; spans also holds those that the patterns discovered, `kind:start:end` by
    kind, then start, comma-joined. Defined cases: null and empty text have no spans; repeated rows and null ids come
    back as given; an empty table gives no rows; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(docs.mapInArrow(_first_pass, _PASS).withColumn("row", F.monotonically_increasing_id()))
    found = first.select("row", F.explode("found").alias("f")).select("row", "f.*")
    trusted = confident_patterns(found.select("kind", F.explode("contexts").alias("context"), "instance"), spec)
    unseen = found.where("kind is null").select("row", "start", "end", F.explode("contexts").alias("context")).join(trusted, "context").groupBy("row", "start", "end").agg(_best_kind()["kind"].alias("kind"))
    new = unseen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("new"))
    out = first.drop("found").join(new, "row", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", _merged("base", "new").alias("spans"))


def _merged(base: str, new: str):
    """Base spans and new ones in one string, by kind as listed, then start."""

    @F.arrow_udf("string")
    def merge(old: pa.Array, more: pa.Array) -> pa.Array:
        out = []
        for b, m in zip(old.to_pylist(), more.to_pylist(), strict=True):
            if not m:
                out.append(b)
                continue
            spans = [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in b.split(",") if x)] + [(x["kind"], x["start"], x["end"]) for x in m]
            spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            out.append(",".join(f"{k}:{a}:{z}" for k, a, z in spans))
        return pa.array(out, pa.string())

    return F.when(F.col(new).isNull(), F.col(base)).otherwise(merge(F.col(base), F.col(new)))


def redact(docs: DataFrame, spec: Bootstrap = Bootstrap()) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets, as in <email>; other columns stay.

    n_chars, where there is one, becomes the new length. Repeated rows and null ids come back as given, an empty table
    gives no rows, columns may have any names. Of overlapping spans the one that starts first is replaced,
    the longer one of two that start together. Null text stays null, empty text empty. The patterns are learned first;
    up to MOST_PATTERNS of them go to the workers, so that no text is shuffled; more are joined to the rows.
    """
    text_batches(docs.sparkSession)
    names, text = docs.columns, F.col("text").cast("string")
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    found = stored(plain.mapInArrow(_first_pass, _PASS).select(F.explode("found").alias("f")).select("f.kind", F.explode("f.contexts").alias("context"), "f.instance"))
    trusted = stored(confident_patterns(found, spec).groupBy("context").agg(_best_kind().alias("best")).select("context", "best.*"))
    if trusted.count() <= MOST_PATTERNS:
        known = {r["context"]: (r["doubt"], r["kind"]) for r in trusted.collect()}
        out = docs.withColumn("text", F.when(F.col("text").isNotNull(), _redactor(known)(text, F.array().cast("array<string>"))))
    else:
        row, patterns = unused(docs, "row"), unused(docs, "patterns")
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
        again = rows.select(F.col(row).alias("doc_id"), text.alias("text")).mapInArrow(_first_pass, _PASS)
        unseen = again.select("doc_id", F.explode("found").alias("f")).where("f.kind is null").select("doc_id", F.explode("f.contexts").alias("context"))
        named = unseen.join(trusted, "context").groupBy(F.col("doc_id").alias(row)).agg(F.collect_set(F.concat_ws("\t", F.col("doubt").cast("string"), "kind", "context")).alias(patterns))
        joined_ = rows.join(named, row, "left")
        known_here = F.coalesce(patterns, F.array().cast("array<string>"))
        out = joined_.withColumn("text", F.when(F.col("text").isNotNull(), _redactor({})(text, known_here)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in names])


#: So many trusted patterns go to every worker at most.
MOST_PATTERNS = 200_000


def _redactor(trusted: dict[str, tuple[float, str]]):
    """Of (text, patterns of this row as `doubt<tab>kind<tab>context`)."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, own: pa.Array) -> pa.Array:
        release()
        out = []
        for text, more in zip(texts.to_pylist(), own.to_pylist(), strict=True):
            if not text:
                out.append(text)
                continue
            known = trusted if not more else {c: (float(d), k) for d, k, c in (x.split("\t", 2) for x in more)}
            base = base_spans(text)
            spans = [(a, -b, k) for k in KINDS for a, b in base[k]]
            if known:
                spans += [(a, -b, min(kinds)[1]) for kind, cs, _, a, b in instances(text, base) if kind is None and (kinds := [known[c] for c in cs if c in known])]
            parts, last = [], 0
            for a, b, k in sorted(spans):
                if a >= last:
                    parts += [text[last:a], f"<{k}>"]
                    last = -b
            out.append("".join([*parts, text[last:]]))
        return pa.array(out, pa.string())

    return run


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
