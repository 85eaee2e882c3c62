"""Best-fit packing of tokenized documents into fixed-length sequences, by linear grouping.

Large pieces are sorted by length and cut into groups of equal cardinality; each is rounded up to the largest length of
its group, so only a few sizes are left. Configurations of these sizes that fill a sequence best are found one after
another and used as often as the counts allow. Then the actual pieces take the places of the rounded ones, which opens
gaps of known size, and the small pieces go by decreasing length into the tightest gap that takes them.

Equal lengths are interchangeable. So the plan is made from a histogram alone, which has at most `capacity` rows
whatever the corpus, as ranges (length, rank from, rank to) -> sequences; and every piece finds its own place by its
length and its rank among the pieces of that length. Ranks come from counts per task and a running sum over tasks: no
sort of the corpus, and no group is gathered anywhere.
"""

from __future__ import annotations

import gc
import struct
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FAR, LONGEST_REMEMBERED, NEAR, Cutter, held, release, stored, table, text_batches, trim


@dataclass(frozen=True)
class Packing:
    """tokenizer: path of a `tokenizers` file. groups: how many sizes the large pieces are rounded to. small: pieces up
    to this share of capacity are placed last. Each pair of the two is planned; the plan with fewest sequences stands.
    batch, remembered: texts that a worker takes at once, and words it keeps from batch to batch; more take memory and save
    time, and results are the same.
    """

    tokenizer: str
    capacity: int = 2048
    end_id: int = 0
    groups: tuple[int, ...] = (64, 256, 1024)
    small: tuple[float, ...] = (0.125, 0.25, 0.5)
    batch: int = 1024
    remembered: int = 200_000


class WordIds:
    """Token ids as little-endian uint32 bytes, put together from parts of the text that no token joins.

    The tokenizer splits at white space, between letters, digits and other characters, and after each digit. So texts
    are split at spaces and line feeds, which give no tokens, and each word of a batch is looked at once: it is cut where
    both characters are plain (below U+0250, so that no normalisation joins them) and neither is an apostrophe, and the
    parts that are new are encoded in one call. Words that hold a special token are encoded whole.
    """

    def __init__(self, path: str, remembered: int = 200_000):
        """remembered: words and parts kept from batch to batch, about so many, and as many older ones; no long ones."""
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        last = {i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")}
        self.ends_word = np.array([i in last for i in range(self.tokenizer.get_vocab_size())])
        kind = np.array([_kind(chr(c)) for c in range(NEAR)] + ["", ""])
        joined = np.ones((FAR + 1, FAR + 1), bool)
        near = (kind[:NEAR, None] == kind[None, :NEAR]) & (kind[:NEAR, None] != "digit")
        near |= (kind[:NEAR, None] == "'") & (kind[None, :NEAR] != "space") | (kind[None, :NEAR] == "'") & (kind[:NEAR, None] != "space")
        joined[:NEAR, :NEAR] = near
        self.cutter = Cutter(joined)
        self.cutter.cut[ord(" "), :] = self.cutter.cut[:, ord(" ")] = True

    def _one(self, part: str) -> bytes:
        return struct.pack(f"<{len(ids := self.tokenizer.encode(part, add_special_tokens=False).ids)}I", *ids)

    def _encoded(self, parts: set[str]) -> dict[str, bytes]:
        """Parts that are one plain word each go into one call and are told apart by their last token."""
        plain = [p for p in parts if len(p) < 64 and "'" not in p and p != " " and p.isprintable() and (p.isascii() or max(p) < chr(NEAR))]
        found: dict[str, bytes] = {}
        if plain:
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) == len(plain):
                data = ids.tobytes()
                found = {p: data[a:b] for p, a, b in zip(plain, [0, *ends], ends, strict=False)}
        return found | {p: self._one(p) for p in parts.difference(found)}

    def _missing(self, words: set[str]) -> set[str]:
        """The words that are not remembered; of those remembered for long, what is asked for becomes recent again."""
        missing = words.difference(self.recent)
        new = missing.difference(self.older)
        again = missing.difference(new)
        self.recent.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return new

    def _remember(self, words: set[str]) -> list[str]:
        """Makes all words, without a special token, recent: new ones are cut, and their new parts encoded. Returns long ones."""
        if len(self.recent) >= self.remembered:
            self.recent, self.older = {}, self.recent
        rest = list(self._missing(words))
        if not rest:
            return []
        parts = self.cutter(" ".join(rest))
        self.recent.update(self._encoded(self._missing(set(parts) - {" "})))
        ids = self.recent.__getitem__
        at = [-1, *(i for i, p in enumerate(parts) if p == " "), len(parts)]
        self.recent.update([(w, b"".join(map(ids, parts[a + 1 : b]))) for w, a, b in zip(rest, at, at[1:], strict=False) if b - a > 2])
        return [w for w in rest if len(w) > LONGEST_REMEMBERED]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty. Words are numbered by Arrow, so Python sees each once in a batch."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        special = {w for w in words if any(s in w for s in self.specials)} if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.specials) else set()
        long = self._remember({w for w in words if w and w not in special})
        known = {w: self._one(w) for w in special} | {"": b""}
        ids = pa.array([known[w] if w in known else self.recent[w] for w in words], pa.large_binary()).take(coded.indices)
        for w in long:
            self.recent.pop(w, None)
        _, offsets, data = ids.buffers()
        data = memoryview(data) if data else memoryview(b"")
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1, 8 * ids.offset)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _kind(c: str) -> str:
    category = unicodedata.category(c)[0]
    return c if c == "'" else "space" if c in " \n" else "letter" if category == "L" else "digit" if category == "N" else "other"


def _pieces(spec: Packing):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        words, end = held(WordIds, spec.tokenizer, spec.remembered), np.asarray([spec.end_id], "<u4").tobytes()
        seen = np.zeros(spec.capacity + 1, np.int64)  # pieces of each length so far in this task
        step = 4 * spec.capacity
        gc.disable()  # nothing here makes cycles, and the collector would go through all words of a batch many times
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            rows.clear()
        gc.enable()
        trim()

    return run


def pieces(docs: DataFrame, spec: Packing) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32, task, nth); nth from 0 among a task's equal lengths.

    Written to the shared scratch folder, so that task and nth stay what they are.
    """
    text_batches(docs.sparkSession, spec.batch)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(docs.mapInArrow(_pieces(spec), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"))


def ranked(found: DataFrame) -> DataFrame:
    """Adds rank, from 0 among all pieces of a length: the counts of earlier tasks and the place in its own."""
    counts = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offset = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(offset, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))


class Plan:
    """Where the pieces go: ranges of (length, rank) and the sequences that take them.

    A row (length, lo, hi, first, each, offset): piece `rank` of the range goes to sequence first + (rank - lo) // each,
    at offset + (rank - lo) % each * length.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int, small: float):
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        #: Runs of like sequences by what is free in them: free -> [(first sequence, how many)].
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        limit = int(capacity * small)
        self._place_large({k: v for k, v in histogram.items() if k > limit}, groups)
        for length in sorted((k for k in histogram if k <= limit), reverse=True):
            self._place_small(length, histogram[length])

    def _open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def _place_large(self, histogram: dict[int, int], groups: int) -> None:
        # Linear grouping: (size, pieces of the group as runs of one length).
        total, lengths = sum(histogram.values()), sorted(histogram, reverse=True)
        share = max(1, -(-total // groups))
        queues: dict[int, list[list[int]]] = {}  # size -> [length, next rank, end rank]
        size, left = 0, 0
        for length in lengths:
            rank, n = 0, histogram[length]
            while rank < n:
                if not left:
                    size, left = length, share
                take = min(left, n - rank)
                queues.setdefault(size, []).append([length, rank, rank + take])
                rank, left = rank + take, left - take
        counts = {s: sum(e - r for _, r, e in q) for s, q in queues.items()}
        while counts:
            config = _best_configuration(counts, self.capacity)
            times = min(counts[s] // k for s, k in config.items())
            slots = [s for s, k in config.items() for _ in range(k)]
            self._use(slots, times, queues)
            for s, k in config.items():
                counts[s] -= k * times
                if not counts[s]:
                    del counts[s]

    def _use(self, slots: list[int], times: int, queues: dict[int, list[list[int]]]) -> None:
        """Open `times` sequences with these slots; actual pieces, run by run, take the places of rounded ones."""
        taken = []
        for s in slots:
            runs, need = [], times
            while need:
                head = queues[s][0]
                n = min(need, head[2] - head[1])
                runs.append([head[0], head[1], n])
                head[1] += n
                need -= n
                if head[1] == head[2]:
                    queues[s].pop(0)
            taken.append(runs)
        while times:
            n = min(runs[0][2] for runs in taken)
            first, offset = self._open(n), 0
            for runs in taken:
                length, rank, _ = runs[0]
                self.rows.append((length, rank, rank + n, first, 1, offset))
                offset += length
                runs[0] = [length, rank + n, runs[0][2] - n]
                if not runs[0][2]:
                    runs.pop(0)
            self._free(self.capacity - offset, first, n)
            times -= n

    def _free(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count:
            self.gaps.setdefault(gap, []).append((first, count))

    def _place_small(self, length: int, count: int) -> None:
        rank = 0
        for gap in sorted(g for g in self.gaps if g >= length):
            each = gap // length
            while rank < count and self.gaps.get(gap):
                first, n = self.gaps[gap].pop()
                used = min(n, (count - rank) // each)
                if used:
                    self.rows.append((length, rank, rank + used * each, first, each, self.capacity - gap))
                    rank += used * each
                    self._free(gap - each * length, first, used)
                if used < n:
                    rest = count - rank
                    if rest < each and rest:  # the last pieces share one sequence
                        self.rows.append((length, rank, count, first + used, each, self.capacity - gap))
                        self._free(gap - rest * length, first + used, 1)
                        rank, used = count, used + 1
                    self._free(gap, first + used, n - used)
            if not self.gaps.get(gap):
                self.gaps.pop(gap, None)
            if rank == count:
                return
        each = self.capacity // length
        full, rest = divmod(count - rank, each)
        first = self._open(full + bool(rest))
        self.rows.append((length, rank, count, first, each, 0))
        self._free(self.capacity - each * length, first, full)
        if rest:
            self._free(self.capacity - rest * length, first + full, 1)


def best_plan(histogram: dict[int, int], spec: Packing) -> Plan:
    """The plan with fewest sequences, of those equal the first."""
    plans = (Plan(histogram, spec.capacity, g, s) for g in spec.groups for s in spec.small)
    return min(plans, key=lambda p: p.sequences)


def _best_configuration(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """With one piece of the largest size, the sizes that fill a sequence best: a bounded knapsack over totals.

    Among equal totals the one found first, that is with larger sizes, stands.
    """
    sizes = sorted(counts, reverse=True)
    top = sizes[0]
    room = capacity - top
    came: list[tuple[int, int] | None] = [None] * (room + 1)  # total -> (total before, size added)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    for s in sizes:
        for _ in range(min(counts[s] - (s == top), room // s)):
            new = np.zeros_like(reach)
            new[s:] = reach[: room + 1 - s]
            new &= ~reach
            fresh = np.flatnonzero(new)
            if not len(fresh):
                break
            for t in fresh.tolist():
                came[t] = (t - s, s)
            reach |= new
        if reach[room]:
            break
    total = int(np.flatnonzero(reach)[-1])
    config = {top: 1}
    while total:
        total, s = came[total]
        config[s] = config.get(s, 0) + 1
    return config


def _lookup(rows: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    lengths, starts = np.unique(table[:, 0], return_index=True)
    ends = np.append(starts[1:], len(table))

    def run(batches):
        release()
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            there, first = np.unique(length[order], return_index=True)
            for n, part in zip(there, np.split(order, first[1:]), strict=True):
                k = np.searchsorted(lengths, n)
                at[part] = starts[k] + np.searchsorted(table[starts[k] : ends[k], 1], rank[part], side="right") - 1
            row = table[at]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(sequence), pa.array(offset)], names=[*cols, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, spec: Packing) -> DataFrame:
    """docs (doc_id long, text string, ...) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text, then end_id. Only documents longer than the capacity are cut, into full pieces
    and a rest. Defined cases: null and empty text count as the end id alone; rows that repeat a doc_id, and null ids,
    are packed as often as given; an empty table gives no rows; other columns are ignored. Texts of any length are taken whole.
    The histogram that goes to the driver has at most `capacity` rows, the plan a few for each of them and each group.
    """
    found = pieces(docs, spec)
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    out = T.StructType.fromDDL("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    if not histogram:
        return docs.sparkSession.createDataFrame([], out)
    text_batches(docs.sparkSession, 10_000)
    return ranked(found).mapInArrow(_lookup(best_plan(histogram, spec).rows), out)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), Packing(public_tokenizers.path("word_bpe_49k.json")))
