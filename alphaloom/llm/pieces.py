"""A unigram piece vocabulary: its lattice, token counts, n-best segmentation, encoding and decoding.

Vocabulary and scores come from a SentencePiece file whose path is a parameter. Here they are read as a unigram model
(the score of a segmentation is the sum of its pieces' scores), which is what Viterbi and n-best search are defined on,
also where the file was made for merges. Text is taken as SentencePiece does with this file: no normalisation, spaces
become U+2581, one is put in front, characters without a piece fall back to their UTF-8 bytes.

Between two characters that stand next to each other in no piece every segmentation has a boundary. A text is cut at
all of these, at word ends among others; its best segmentation is that of the parts one after another, and its n best
come from a few of their alternatives. Parts are solved once for each worker and kept in a memo of bounded size. Sums are 64-bit, so long texts lose no precision.

Tie rules are the tokenizer's: of equally good paths to a position the one whose last piece starts first stands; a
character without a piece of its own is unknown at 10 below the lowest score, and comes last.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FAR, MARK, Cutter, Memo, held, table, text_batches, utf8

SPACE = "▁"
#: Fixed value: what an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Read from path on the worker that uses it. matcher: all pieces in one Aho-Corasick automaton."""

    path: str
    matcher: ahocorasick.Automaton = field(init=False)

    def __post_init__(self):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = sp.get_piece_size()
        self.matcher = ahocorasick.Automaton()
        self.singles: set[str] = set()
        self.as_bytes: list[bytes] = []
        self.byte_ids = [sp.unk_id()] * 256
        lowest, joined = 0.0, np.zeros((FAR + 1, FAR + 1), bool)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.as_bytes.append(bytes([value]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.as_bytes.append(b"")
                continue
            self.as_bytes.append(piece.replace(SPACE, " ").encode())
            score = float(sp.get_score(i))
            lowest = min(lowest, score)
            self.matcher.add_word(piece, (len(piece), score, i))
            code = [MARK if c == SPACE else min(ord(c), FAR) for c in piece]
            joined[code[:-1], code[1:]] = True
            if len(piece) == 1:
                self.singles.add(piece)
        self.matcher.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.cutter = Cutter(joined)

    def split(self, text: str) -> list[str]:
        """The parts of a text that no piece joins. An empty text has none."""
        return self.cutter(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, word: str) -> int:
        """Pieces of the best segmentation, without its path: each position carries the best score and its count."""
        n = len(word)
        best, pieces = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0], at, singles = 0.0, 0, self.singles
        for end, (size, score, _) in self.matcher.iter(word):
            while at < end:
                if word[at] not in singles:
                    self._unknown(word, at, best, pieces)
                at += 1
            # Longer matches of an end come first: a later one must be better to replace them.
            start = end + 1 - size
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], pieces[end + 1] = total, pieces[start] + 1
        for at in range(at, n):
            if word[at] not in singles:
                self._unknown(word, at, best, pieces)
        return pieces[n]

    def _unknown(self, word: str, at: int, best: list[float], pieces: list[int]) -> None:
        total = best[at] + self.unknown
        if total > best[at + 1]:
            best[at + 1], pieces[at + 1] = total, pieces[at] + len(word[at].encode())

    def best_two(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """ids of the best segmentation, its score, and how much worse the second best is (infinity without one).

        The second best takes an edge that is not on the best path: the best score before it, its own and the best
        score behind it.
        """
        n, singles = len(word), self.singles
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0], at, edges = 0.0, 0, []
        for last, (size, score, i) in self.matcher.iter(word):
            while at < last:
                if word[at] not in singles:
                    edges.append((at, at + 1, self.unknown))
                    if best[at] + self.unknown > best[at + 1]:
                        best[at + 1], back[at + 1] = best[at] + self.unknown, (at, -1)
                at += 1
            end = last + 1
            start = end - size
            edges.append((start, end, score))
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, i)
        for at in range(at, n):
            if word[at] not in singles:
                edges.append((at, at + 1, self.unknown))
                if best[at] + self.unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + self.unknown, (at, -1)
        path, flat, at = [-1] * (n + 1), [], n
        while at:
            start, i = back[at]
            path[at] = start
            flat += [self.byte_ids[b] for b in reversed(word[start].encode())] if i < 0 else [i]
            at = start
        behind, second = [float("-inf")] * n + [0.0], float("-inf")
        for start, end, score in reversed(edges):  # by falling end, so what is behind an end is known
            rest = behind[end] + score
            if rest > behind[start]:
                behind[start] = rest
            if path[end] != start and best[start] + rest > second:
                second = best[start] + rest
        return tuple(reversed(flat)), best[n], best[n] - second

    def lattice(self, word: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """For each end the edges (start, score, id) that reach it, earliest start first, and the best score to it.

        The id of an unknown character is -1.
        """
        n = len(word)
        edges: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for end, (size, score, i) in self.matcher.iter(word):
            edges[end + 1].append((end + 1 - size, score, i))
        best = [0.0] * (n + 1)
        for end in range(1, n + 1):
            if word[end - 1] not in self.singles:
                edges[end].append((end - 1, self.unknown, -1))
            best[end] = max([best[s] + score for s, score, _ in edges[end]])
        return edges, best

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids), best first: A* from the end backwards.

        What is left before a position costs exactly what the forward pass found, so each popped path is part of the
        next best one. Ties go to the path that has come further to the front, then to the one found first.
        """
        edges, best = self.lattice(word)
        heap: list[tuple] = [(-best[-1], len(word), 0, 0.0, None)]
        found, serial = [], 1
        while heap and len(found) < n:
            low, at, _, tail, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    i, start, path = path
                    ids += [self.byte_ids[b] for b in word[start].encode()] if i < 0 else [i]
                found.append((-low, tuple(ids)))
                continue
            for start, score, i in edges[at]:
                behind = tail + score
                heapq.heappush(heap, (-(best[start] + behind), start, serial, behind, (i, start, path)))
                serial += 1
        return found


class Encoder:
    """Whole texts to ids and scores of their n best segmentations, and back."""

    def __init__(self, path: str, n: int):
        self.vocabulary, self.n = Vocabulary(path), n
        self.memo = Memo(self._two, 400_000)
        self.choices = Memo(lambda word: self.vocabulary.n_best(word, n), 20_000)

    def _two(self, word: str) -> tuple[bytes, float, float]:
        """ids of the best as uint32 bytes, its score, and how much worse the second is."""
        ids, score, loss = self.vocabulary.best_two(word)
        return struct.pack(f"<{len(ids)}I", *ids), score, loss

    def encode(self, text: str | None) -> tuple[bytes, list[float], list[list[tuple[int, tuple[int, ...]]]]]:
        """ids of the best, the n best scores, and for each of the n the words (place, ids) in which it differs.

        With N wanted, only the N - 1 words whose second choice costs least can differ in any of them.
        """
        words = self.vocabulary.split(text or "")
        solved = list(map(self.memo.__getitem__, words))
        ids = b"".join([s[0] for s in solved])
        score = sum([s[1] for s in solved])
        if not words or self.n < 2:
            return ids, [score], [[]]
        loss = np.array([s[2] for s in solved])
        k = min(self.n - 1, len(words))
        edge = np.partition(loss, k - 1)[k - 1]
        places = np.concatenate([np.flatnonzero(loss < edge), np.flatnonzero(loss == edge)])[:k]
        choices = [(int(p), self.choices[words[p]]) for p in places if np.isfinite(loss[p])]
        scores, changes = [], []
        heap, seen = [(0.0, (0,) * len(choices))], {(0,) * len(choices)}
        while heap and len(scores) < self.n:
            lost, pick = heapq.heappop(heap)
            scores.append(score - lost)
            changes.append([(p, c[j][1]) for (p, c), j in zip(choices, pick, strict=True) if j])
            for q, (_, c) in enumerate(choices):
                if pick[q] + 1 < len(c) and (nxt := (*pick[:q], pick[q] + 1, *pick[q + 1 :])) not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (lost + c[pick[q]][0] - c[pick[q] + 1][0], nxt))
        return ids, scores, changes

    def segmentations(self, text: str | None) -> list[list[int]]:
        """The ids of the n best segmentations."""
        return self.spelled_out(text, self.encode(text)[2])

    def spelled_out(self, text: str | None, changes: list[list[tuple[int, tuple[int, ...]]]]) -> list[list[int]]:
        """The ids of segmentations that encode tells by the words in which they differ from the best."""
        base = [np.frombuffer(self.memo[w][0], "<u4").tolist() for w in self.vocabulary.split(text or "")]
        out = []
        for change in changes:
            own = list(base)
            for p, ids in change:
                own[p] = list(ids)
            out.append([i for part in own for i in part])
        return out

    def decode(self, ids: list[int]) -> str:
        """Back to text: bytes of the pieces, without the space that was put in front. Bad UTF-8 becomes U+FFFD."""
        return b"".join(map(self.vocabulary.as_bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _counter(path: str) -> tuple[Vocabulary, Memo]:
    vocabulary = Vocabulary(path)
    return vocabulary, Memo(vocabulary.count)


def _counts(path: str):
    def run(batches):
        vocabulary, memo = held(_counter, path)
        for batch in batches:
            texts = [t.decode() if t else "" for t in utf8(batch.column("text"))]
            n = [sum(map(memo.__getitem__, vocabulary.split(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return run


def _ready(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, n_tokens per row, without a shuffle.

    Defined cases: null and empty text have no tokens; repeated rows and null ids come back as given; an empty table
    gives no rows; other columns are ignored. Texts of any length are counted whole, one of many megabytes as a batch of its own.
    """
    return _ready(docs).mapInArrow(_counts(path), "doc_id long, n_chars long, n_tokens long")


def _encode(path: str, n: int):
    def run(batches):
        encoder = held(Encoder, path, n)
        for batch in batches:
            texts = [t.decode() if t else "" for t in utf8(batch.column("text"))]
            solved = [encoder.encode(t) for t in texts]
            found = [encoder.spelled_out(t, changes) for t, (_, _, changes) in zip(texts, solved, strict=True)]
            scores = [s for _, s, _ in solved]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(scores, pa.list_(pa.float64()))],
                names=["doc_id", "segmentations", "scores"],
            )

    return run


def encode(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, segmentations array<array<int>>, scores array<double>, the best first.

    A text with fewer than n segmentations returns them all; null and empty text have one, without ids. Repeated rows and
    null ids come back as given, an empty table gives no rows, other columns are ignored, whatever they are called. Texts of
    any length are encoded whole, one of many megabytes as a batch of its own.
    """
    return _ready(docs).mapInArrow(_encode(path, n), "doc_id long, segmentations array<array<int>>, scores array<double>")


def _decode(path: str):
    def run(batches):
        encoder = held(Encoder, path, 1)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(doc_id, ids array<int>) -> doc_id, text. Null ids give null, no ids an empty text.

    Repeated rows and null doc_ids come back as given, an empty table gives no rows, other columns are ignored.
    """
    text_batches(encoded.sparkSession)
    ready = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return ready.mapInArrow(_decode(path), "doc_id long, text string")


def _digest(path: str, n: int):
    def run(batches):
        encoder = held(Encoder, path, n)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                text = text.decode() if text else ""
                ids, scores, changes = encoder.encode(text)
                same = encoder.decode(np.frombuffer(ids, "<u4").tolist()) == text
                rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), scores, [len(c) for c in changes], same))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.bool_()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_tokens", "ids_crc32", "scores", "words_changed", "round_trip"])

    return run


def encode_digest(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """docs -> doc_id, n_tokens, ids_crc32 of the best ids, scores of the n best, words_changed, round_trip.

    round_trip: whether decoding the best ids gives the whole text back. Null and empty text have no ids. Repeated rows and
    null ids come back as given, an empty table gives no rows, other columns are ignored.
    """
    return _ready(docs).mapInArrow(_digest(path, n), "doc_id long, n_tokens long, ids_crc32 long, scores array<double>, words_changed array<int>, round_trip boolean")


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _path())


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), _path())
