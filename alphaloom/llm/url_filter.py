"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after another into a Shift-And automaton of as many 64-bit words as they need. One step per
character advances all rules at once: `D = ((D << 1) | starts) & match[c] | D & stay[c]`, the words carrying into each
other. A `*` keeps its state alive over any character, a `[^/]*` written as `@` over any but a slash. The step is
vectorised over the URLs of an Arrow batch, so the work per URL is its length times the number of words.

Globs see the canonical URL `.host` + path + query. A host holds neither a slash nor a question mark, and the `@` of a
host rule crosses neither, so `@.example.net/en/*` fits the host, all of its subdomains and no path or query that
happens to look like it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, text_batches

#: The host and path rules of the query, (verdict, host, path).
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Globs that judge what no host rule fits: downloads, trackers, log-in and session pages.
GLOBS = (
    "*.exe", "*.zip", "*.jpg", "*.png", "*.gif", "*.css", "*.js",
    "*/login*", "*/logout*", "*/cart/*", "*?*sessionid=*", "@.doubleclick.@/*",
)

#: Words of addresses that are not wanted: gambling, medicines, adult content, fraud and piracy, advertising.
WORDS = (
    "casino", "casinos", "poker", "bets", "betting", "jackpot", "slots", "roulette", "blackjack", "bingo", "lottery", "gambling",
    "pills", "pharmacy", "viagra", "cialis", "xanax", "tramadol", "steroids", "weightloss",
    "adult", "porn", "porno", "xxx", "escort", "escorts", "webcam", "nude", "hentai", "fetish",
    "spam", "scam", "phishing", "malware", "warez", "torrent", "torrents", "keygen", "cracked", "serials", "hack", "proxy",
    "ads", "adserver", "adservice", "banner", "banners", "popup", "popups", "track", "tracker", "trackers", "tracking", "pixel", "affiliate", "affiliates", "clickbait", "telemetry", "beacon",
)
#: Where a word counts: as a label of the host, as a part of one between hyphens, or as a folder of the path.
FORMS = ("@.{}.*", "@.{}-*", "@-{}.*", "@-{}-*", "@-{}/*", "*/{}/*")


@dataclass(frozen=True)
class Rule:
    """name: what is reported. glob: over the canonical URL. verdict: allow or block. weight: the largest wins.

    stops: the characters that an `@` of the glob does not cross.
    """

    name: str
    glob: str
    verdict: str
    weight: int
    stops: str = "/"


def glob_rules() -> list[Rule]:
    """The globs and every word in every form: some 360 rules, 3,600 states. The longest that fits is reported."""
    made = [f.format(w) for w in WORDS for f in FORMS]
    return [Rule(g, g, "block", len(g)) for g in GLOBS] + [Rule(g, g, "block", len(g), "/?") for g in made]


def host_rule(verdict: str, host: str, path: str) -> Rule:
    return Rule(host + path, f"@.{host}{path}*", verdict, len(host) + len(path), "/?")


class Automaton:
    """All rules in one Shift-And automaton. A glob's trailing `*` means that the rest may be anything."""

    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda r: (-r.weight, r.name))  # the first set bit is the rule that wins
        size = sum(len(_states(r.glob)) for r in self.rules)
        self.words = max(1, -(-size // 64))
        self.match = np.zeros((256, self.words), np.uint64)  # bits that may be entered by a character
        self.stay = np.zeros((256, self.words), np.uint64)  # bits that a character leaves alive
        self.starts = np.zeros(self.words, np.uint64)  # bits alive before the first character
        self.first = np.zeros(self.words, np.uint64)  # first bits of rules: nothing is shifted into them
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for rule in self.rules:
            for i, (char, loop) in enumerate(_states(rule.glob)):
                word, bit = divmod(at + i, 64)
                one = np.uint64(1) << np.uint64(bit)
                if i == 0:
                    self.starts[word] |= one
                    self.first[word] |= one
                else:
                    self.match[char, word] |= one
                if loop == "*":
                    self.stay[:, word] |= one
                elif loop == "@":
                    self.stay[~np.isin(np.arange(256), list(rule.stops.encode())), word] |= one
            at += len(_states(rule.glob))
            self.ends.append(divmod(at - 1, 64))

    def winners(self, urls: list[bytes]) -> np.ndarray:
        """The index into self.rules of each URL's rule, -1 if none fits."""
        n = len(urls)
        won = np.full(n, -1, np.int64)
        if not n:
            return won
        length = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-length, kind="stable")
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])[order]
        length = length[order]
        buf = np.frombuffer(b"".join(urls) or b"\0", np.uint8)
        live = np.tile(self.starts, (n, 1))
        for i in range(int(length[0])):
            m = int(np.searchsorted(-length, -i, side="left"))  # URLs longer than i come first
            c = buf[starts[:m] + i]
            d = live[:m]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            live[:m] = (moved & ~self.first & self.match[c]) | (d & self.stay[c])
        for k in range(len(self.rules) - 1, -1, -1):
            word, bit = self.ends[k]
            hit = (live[:, word] >> np.uint64(bit)) & np.uint64(1)
            won[order[hit.astype(bool)]] = k
        return won


def _states(glob: str) -> list[tuple[int, str]]:
    """(character that enters the state, what it stays alive over), the first state being the one before all input."""
    states: list[list] = [[0, ""]]
    for c in glob.encode():
        if chr(c) in "*@":
            states[-1][1] = "*" if chr(c) == "*" or states[-1][1] == "*" else "@"
        else:
            states.append([c, ""])
    return [tuple(s) for s in states]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host (A-Z lower-cased), path, and the rest after the path. Without `://` all are empty.

    The host ends at the first `/`, `?`, `#`; the path at the first `?`, `#`. Ports and user names stay in the host.
    """
    url = F.coalesce(url.cast("string"), F.lit(""))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^/?#]*[^?#]*(\??[^#]*)", 1)
    return host, path, rest


def _judge(rules: list[Rule], default: str):
    def run(batches):
        release()
        machine = Automaton(rules)
        names = [r.name for r in machine.rules] + [None]
        verdicts = [r.verdict for r in machine.rules] + [default]
        for batch in batches:
            urls = [u.encode() for u in batch.column("canonical").to_pylist()]
            won = machine.winners(urls)
            cols = [c for c in batch.schema.names if c != "canonical"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in cols] + [pa.array([names[k] for k in won], pa.string()), pa.array([verdicts[k] for k in won], pa.string())],
                names=[*cols, "rule", "verdict"],
            )

    return run


def filter_urls(df: DataFrame, rules: list[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """df -> one row per row: the id column, host, path, rule (name of the rule that wins, or null), verdict.

    Of the rules that fit, the one of the largest weight wins, ties going to the smaller name. No shuffle.
    Defined cases: a null url, an empty one or one without `://` has empty host and path, its canonical form is empty
    and only `*` fits it; URLs of any length are read whole; repeated rows and null ids come back as given; an empty
    table gives no rows; other columns are ignored.
    """
    text_batches(df.sparkSession, 8192)
    host, path, rest = url_parts(df[url_column])
    canonical = F.when(host != "", F.concat(F.lit("."), host, path, rest)).otherwise(F.lit(""))
    ready = df.select(df[id_column].alias(id_column), host.alias("host"), path.alias("path"), canonical.alias("canonical"))
    kind = dict(ready.dtypes)[id_column]
    return ready.mapInArrow(_judge(rules, default), f"`{id_column}` {kind}, host string, path string, rule string, verdict string")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rules first (any of them outweighs a glob); globs block what no host rule fits; the rest is allowed."""
    rules = [replace(r, weight=r.weight + 1_000_000) for r in (host_rule(*x) for x in HOST_RULES)]
    rules += glob_rules()
    judged = filter_urls(table(spark, sf_dir, "pages"), rules)
    named = F.array(*[F.lit(h + p) for _, h, p in HOST_RULES])
    fits = F.array_contains(named, F.col("rule"))
    return judged.select("page_id", "host", "path", F.when(fits, F.col("rule")).alias("rule"), "verdict", F.when(~fits, F.col("rule")).alias("glob"))


def op4_sql() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    query = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*[^?#]*(\\??[^#]*)', 1, 's')"
    fits = [(v, h, p, f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))") for v, h, p in sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for _, h, p, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for v, _, _, f in fits)
    globs = sorted(glob_rules(), key=lambda r: (-r.weight, r.name))
    regex = lambda r: "^" + "".join({"*": ".*", "@": f"[^{r.stops}]*", ".": "\\.", "?": "\\?"}.get(c, c) for c in r.glob) + "$"
    hit = "CASE " + " ".join(f"WHEN host <> '' AND regexp_matches('.' || host || path || query, '{regex(r)}', 's') THEN '{r.name}'" for r in globs) + " END"
    return f"""
      WITH p AS (SELECT page_id, {host} AS host, {path} AS path, {query} AS query FROM pages),
      r AS (SELECT *, {rule} AS rule, {hit} AS hit FROM p)
      SELECT page_id, host, path, rule, {verdict} WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
             CASE WHEN rule IS NULL THEN hit END AS glob
      FROM r"""
