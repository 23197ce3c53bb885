"""Segmentation of texts into the pieces of a SentencePiece vocabulary: the n best ones, and back.

The lattice of a text has an arc for each piece at each place; a segmentation is a path, its score the sum of its
pieces' scores. Blanks become ``U+2581`` and one goes before the text. A character that no piece covers, and a
``U+2581`` of the text itself, is spelt by byte pieces, each at ``UNKNOWN`` below the worst piece. Decoding
gives back exactly the text.

Forward Viterbi scores of the prefixes are exact heuristics for an A* search from the end: what is popped is the
best completion of what is already fixed behind it, so complete paths come out in order of their score. No
piece holds a blank sign behind another character, nor a character that it does not cover, so a text falls into
units that no arc leaves: a run of blanks with the word behind it, or a spelt character. The score of a text is
the sum over its units, hence its n best segmentations differ from the best one only in the n - 1 units whose
second-best score is least behind; A* runs on those. The Viterbi pass runs once for each different unit of a
batch, for all units of one length together, and also says how far the second best is behind.

Texts are encoded where they lie: no shuffle, and no table but the vocabulary, which has a fixed size and is
broadcast. Known units are kept in a cache of about ``CACHE`` entries and ``CACHE_CHARS`` characters per task.

Among equal scores the segmentation whose last differing piece starts earliest (the longest one) comes first. Null texts
give null; empty texts give no pieces and score 0. Other columns are never read. Very long units are handled
one by one, in time and memory linear in their length: arcs lie in arrays, and the search keeps ``n`` paths.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.batches import CHUNK_BYTES, text_chunks, tidied

MARK = "▁"
UNKNOWN = -10.0
CACHE = 50_000
#: Characters of the units in the cache, beyond which it is emptied.
CACHE_CHARS = 1 << 21
#: Units longer than this are not put together with others.
LONG = 40
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces with their scores, as a trie in flat arrays: (node, character) -> node, node -> piece and score."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: dict[int, int]):
        worst = min((s for s in scores if s > -1e8), default=0.0)
        # pieces without a score of their own carry a huge penalty in the file; they count as the worst piece
        scores = [s if s > -1e8 else worst for s in scores]
        self.pieces, self.scores, self.bytes_at = pieces, scores, bytes_at
        self.bottom = worst + UNKNOWN
        chars = sorted({c for i, p in enumerate(pieces) if i not in set(bytes_at.values()) for c in p})
        self.char_of = {c: k + 1 for k, c in enumerate(chars)}
        special = set(bytes_at.values())
        children: dict[tuple[int, int], int] = {}
        self.node_piece = [-1]
        for i, piece in enumerate(pieces):
            if i in special or not piece:
                continue
            node = 0
            for c in piece:
                node = children.setdefault((node, self.char_of[c]), len(self.node_piece))
                if node == len(self.node_piece):
                    self.node_piece.append(-1)
            self.node_piece[node] = i
        self.children = children
        self._flatten()

    def _flatten(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.piece_at = np.array(self.node_piece, dtype=np.int32)
        self.score_at = np.array([self.scores[p] if p >= 0 else -np.inf for p in self.node_piece])
        size = 1 << max(4, (4 * len(self.children)).bit_length())
        self.mask = size - 1
        self.keys = np.full(size, -1, dtype=np.int64)
        self.nodes = np.full(size, -1, dtype=np.int32)
        for (node, char), child in self.children.items():
            at = ((node << 20 | char) * int(_HASH) >> 40) & self.mask
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.nodes[at] = node << 20 | char, child
        points = np.array([ord(c) for c in self.char_of], dtype=np.int64)
        self.points = np.zeros(0x110000, dtype=np.int32)
        self.points[points] = list(self.char_of.values())

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children of trie nodes, -1 where there is none."""
        key = node.astype(np.int64) << 20 | char
        at = ((key.view(np.uint64) * _HASH) >> np.uint64(40)).astype(np.int64) & self.mask
        out = self.nodes[at]
        there = self.keys[at]
        other = np.flatnonzero((there != key) & (there >= 0))
        out[there != key] = -1
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            there = self.keys[at[other]]
            hit = there == key[other]
            out[other[hit]] = self.nodes[at[other[hit]]]
            other = other[~hit & (there >= 0)]
        return out

    def spelt(self, char: str) -> tuple[list[int], float]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes_at[b] for b in raw], self.bottom * len(raw)

    def arcs(self, unit: str, start: int) -> Iterator[tuple[int, int, float]]:
        """(end, piece, score) of the arcs from a place; piece -1 spells one character."""
        node, covered = 0, False
        for end in range(start, min(len(unit), start + self.longest)):
            node = self.children.get((node, self.char_of.get(unit[end], 0)), -1)
            if node < 0:
                break
            if self.node_piece[node] >= 0:
                covered |= end == start
                yield end + 1, self.node_piece[node], self.scores[self.node_piece[node]]
        if not covered:
            yield start + 1, -1, self.bottom * len(unit[start].encode("utf-8", "surrogatepass"))


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces = [p.id_to_piece(i) for i in range(n)]
    at = {int(pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
    usable = [("" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else pieces[i]) for i in range(n)]
    return Vocabulary(usable, [p.get_score(i) for i in range(n)], at)


@dataclass(frozen=True)
class Lattice:
    """The arcs of a unit sorted by their ends: those into ``place`` are ``first[place]`` to ``first[place + 1]``.

    ``loss`` is how far the best path to an arc's end by this arc falls behind the best one.
    """

    best: np.ndarray
    first: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    loss: np.ndarray

    def into(self, place: int) -> Iterator[tuple[float, int, int]]:
        a, b = int(self.first[place]), int(self.first[place + 1])
        return zip(self.loss[a:b].tolist(), self.start[a:b].tolist(), self.piece[a:b].tolist())


def forward(v: Vocabulary, unit: str) -> Lattice:
    """The best score of each prefix, and all arcs."""
    best = array("d", [0.0]) + array("d", [-np.inf]) * len(unit)
    starts, ends, pieces, scores = array("i"), array("i"), array("i"), array("d")
    for i in range(len(unit)):
        here = best[i]
        for end, piece, score in v.arcs(unit, i):
            starts.append(i)
            ends.append(end)
            pieces.append(piece)
            scores.append(here + score)
            if here + score > best[end]:
                best[end] = here + score
    best, ends = np.frombuffer(best), np.frombuffer(ends, dtype=np.int32)
    order = np.argsort(ends, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(unit) + 1))])
    loss = best[ends[order]] - np.frombuffer(scores)[order]
    return Lattice(best, first, np.frombuffer(starts, dtype=np.int32)[order], np.frombuffer(pieces, dtype=np.int32)[order], loss)


def n_best(v: Vocabulary, unit: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a unit, best first: A* from its end.

    What a partial path loses against the best one is exactly what its best completion loses, and no two of them
    share a completion. So no more of them are kept than segmentations are missing, and of equal ones the latest goes first:
    the search runs straight to the start and does not spread over equally good paths.
    """
    lattice = forward(v, unit)
    turn = count(0, -1)
    open_paths = [(0.0, next(turn), len(unit), None)]
    out: list[tuple[float, list[int]]] = []
    while open_paths and len(out) < n:
        loss, _, place, path = open_paths.pop(0)
        if place == 0:
            ids: list[int] = []
            while path:
                (start, piece), path = path
                ids += [piece] if piece >= 0 else v.spelt(unit[start])[0]
            out.append((float(lattice.best[-1]) - loss, ids))
            continue
        # the earliest start is the latest to enter, so it goes first among equal ones
        for own, start, piece in reversed([*lattice.into(place)]):
            open_paths.append((loss + own, next(turn), start, ((start, piece), path)))
        open_paths = heapq.nsmallest(n - len(out), open_paths)
    return out


def _one(v: Vocabulary, unit: str) -> tuple[float, float, list[int]]:
    """(best score, how far the second best is behind, pieces) of one unit, in steps linear in its length."""
    lattice = forward(v, unit)
    place, gap, path = len(unit), np.inf, []
    while place:
        into = [*lattice.into(place)]
        top = min(into, key=lambda x: x[0])
        gap = min([gap, *[arc[0] for arc in into if arc is not top]])
        path.append((top[1], top[2]))
        place = top[1]
    ids: list[int] = []
    for start, piece in reversed(path):
        ids += [piece] if piece >= 0 else v.spelt(unit[start])[0]
    return float(lattice.best[-1]), gap, ids


def _many(v: Vocabulary, units: list[str], length: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The same for many units of one length at once."""
    n = len(units)
    points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).reshape(n, length)
    chars = v.points[points]
    spelt = v.bottom * (1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    second = np.full((n, length + 1), -np.inf)
    start_of = np.zeros((n, length + 1), dtype=np.int32)
    piece_of = np.full((n, length + 1), -1, dtype=np.int32)

    def arrive(rows, end, start, piece, score):
        old = best[rows, end]
        better = score > old
        second[rows, end] = np.where(better, old, np.maximum(second[rows, end], score))
        won = rows[better]
        best[won, end], start_of[won, end] = score[better], start
        piece_of[won, end] = piece[better] if isinstance(piece, np.ndarray) else piece

    for i in range(length):
        rows, node = np.arange(n), np.zeros(n, dtype=np.int32)
        for end in range(i, min(length, i + v.longest)):
            node = v.step(node, chars[rows, end])
            alive = node >= 0
            rows, node = rows[alive], node[alive]
            piece = v.piece_at[node]
            is_piece = piece >= 0
            if end == i:
                uncovered = np.ones(n, dtype=bool)
                uncovered[rows[is_piece]] = False
                bare = np.flatnonzero(uncovered)
                if len(bare):
                    arrive(bare, i + 1, i, -1, best[bare, i] + spelt[bare, i])
            if not len(rows):
                break
            hit = rows[is_piece]
            if len(hit):
                arrive(hit, end + 1, i, piece[is_piece], best[hit, i] + v.score_at[node[is_piece]])
    gap = np.full(n, np.inf)
    place = np.full(n, length)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = np.arange(n)
    while len(rows):
        at = place[rows]
        gap[rows] = np.minimum(gap[rows], best[rows, at] - second[rows, at])
        start = start_of[rows, at]
        steps.append((rows, start, piece_of[rows, at]))
        place[rows] = start
        rows = rows[start > 0]
    ids: list[list[int]] = [[] for _ in range(n)]
    for rows, start, piece in reversed(steps):
        for r, s, p in zip(rows.tolist(), start.tolist(), piece.tolist()):
            if p >= 0:
                ids[r].append(p)
            else:
                ids[r] += v.spelt(units[r][s])[0]
    return best[:, length], gap, ids


def best_of_units(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[array]]:
    """(score, gap to the second best, pieces) of each unit."""
    score, gap, ids = np.zeros(len(units)), np.full(len(units), np.inf), [array("i")] * len(units)
    by_length: dict[int, list[int]] = {}
    for k, unit in enumerate(units):
        by_length.setdefault(len(unit), []).append(k)
    for length, where in by_length.items():
        for a in range(0, len(where), 20_000):
            part = where[a : a + 20_000]
            if length > LONG or len(part) < 4:
                found = [_one(v, units[k]) for k in part]
                got = [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]
            else:
                got = _many(v, [units[k] for k in part], length)
            score[part], gap[part] = got[0], got[1]
            for k, x in zip(part, got[2]):
                ids[k] = array("i", x)
    return score, gap, ids


def units_of(text: str) -> list[str | None]:
    """The units of a text; None stands for a blank sign that the text itself has."""
    out: list[str | None] = []
    for k, part in enumerate(text.split(MARK)):
        if k:
            out.append(None)
        part = part.replace(" ", MARK)
        out += _UNITS.findall(part if k else MARK + part)
    return out


class Encoder:
    """Encodes texts and remembers units, at most CACHE of them between two batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.place: dict[str | None, int] = {None: 0}
        own, score = self.v.spelt(MARK)
        self.ids, self.size = np.array(own, dtype=np.int32), np.array([len(own)])
        self.score, self.gap = np.array([score]), np.array([np.inf])
        self.starts = np.array([0])
        self.names: list[str | None] = [None]
        self.alternatives: dict[tuple[int, int], list[tuple[float, list[int]]]] = {}
        self.chars = 0

    def learn(self, units: list[str]) -> None:
        score, gap, ids = best_of_units(self.v, units)
        size = np.array([len(x) for x in ids])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype=np.int32)])
        self.size, self.score, self.gap = np.concatenate([self.size, size]), np.concatenate([self.score, score]), np.concatenate([self.gap, gap])
        self.names += units
        self.chars += sum(map(len, units))

    def encode(self, texts: list[str], n: int) -> Iterator[tuple[float, np.ndarray, list[tuple[float, list[tuple[int, int]]]]]]:
        """Per text: best score, its pieces, and up to ``n`` segmentations as (score, [(unit's number, rank)])."""
        if len(self.place) + len(self.alternatives) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
        place = self.place
        coded, fresh = [], []
        for text in texts:
            units = units_of(text) if text else []
            for u in set(units):
                if u not in place:
                    place[u] = len(place)
                    fresh.append(u)
            coded.append(np.fromiter(map(place.__getitem__, units), dtype=np.int64, count=len(units)))
        if fresh:
            self.learn(fresh)
        for code in coded:
            size = self.size[code]
            at = np.repeat(self.starts[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            total = float(self.score[code].sum())
            yield total, self.ids[at], self._others(code, total, n)

    def _others(self, code: np.ndarray, total: float, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """The n best segmentations, each as the units that differ from the best one, with their ranks."""
        out = [(total, [])]
        if n < 2 or not len(code):
            return out
        gap = self.gap[code]
        near = np.argpartition(gap, n - 2)[: n - 1] if len(gap) > n - 1 else np.arange(len(gap))
        near = near[np.isfinite(gap[near])]
        losses = []
        for k in sorted(near.tolist()):
            unit = int(code[k])
            if (unit, n) not in self.alternatives:
                self.alternatives[unit, n] = n_best(self.v, self.names[unit], n)
            found = self.alternatives[unit, n]
            losses.append((k, [found[0][0] - s for s, _ in found]))
        heap = [(0.0, ())]
        for k, loss in losses:
            heap = heapq.nsmallest(n, ((h + x, (*c, (k, r)) if r else c) for h, c in heap for r, x in enumerate(loss)))
        return [(total - h, list(c)) for h, c in heap]


def encode_texts(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", n: int = 1, out_col: str = "pieces", decoded_col: str | None = None
) -> DataFrame:
    """All columns of ``docs`` with ``pieces`` (array<int>), ``score`` and ``scores`` (of the ``n`` best segmentations).

    With ``decoded_col``, also the text that the pieces give back, in the same pass. Columns of ``docs`` with
    these names are replaced.
    """
    docs = docs.drop(out_col, "score", "scores", *([decoded_col] if decoded_col else []))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    added = [(out_col, "array<int>"), ("score", "double"), ("scores", "array<double>"), *([(decoded_col, "string")] if decoded_col else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, raw = Encoder(shared.value), _raw(shared.value)
        for whole in batches:
            for batch in _by_size(whole, text_col):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                ids, score, scores = [], [], []
                for total, own, others in encoder.encode([t or "" for t in texts], n):
                    ids.append(own)
                    score.append(total)
                    scores.append([s for s, _ in others])
                null = np.array([t is None for t in texts], dtype=bool)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                pieces = pa.ListArray.from_arrays(pa.array(ends), flat)
                pieces = pieces if not null.any() else pa.array([None if x else p for x, p in zip(null, pieces.to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pieces,
                        pa.array(score, mask=null),
                        pa.array([None if x else s for x, s in zip(null, scores)], pa.list_(pa.float64())),
                        *([pa.array([None if x else _text(raw, i) for x, i in zip(null, ids)], pa.string())] if decoded_col else []),
                    ],
                    names=[*batch.schema.names, *(c for c, _ in added)],
                )

    schema = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in added]).schema
    return docs.mapInArrow(tidied(work), schema)


def _by_size(batch: pa.RecordBatch, text_col: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text."""
    texts = batch.column(batch.schema.get_field_index(text_col))
    for a, b, _, _ in text_chunks(texts, size):
        yield batch.slice(a, b - a)


def _raw(v: Vocabulary) -> list[bytes]:
    """The bytes of each piece in a text."""
    raw = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p in v.pieces]
    for b, i in v.bytes_at.items():
        raw[i] = bytes([b])
    return raw


def _text(raw: list[bytes], ids: np.ndarray) -> str:
    text = b"".join([raw[i] for i in ids.tolist()])
    return (text[1:] if text.startswith(b" ") else text).decode("utf-8", "surrogatepass")


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary, pieces_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """All columns with the text of the pieces; null for null. A column of that name is replaced."""
    encoded = encoded.drop(out_col)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _raw(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(pieces_col))
            out = [None if row.values is None else _text(raw, row.values.to_numpy()) for row in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(tidied(work), encoded.select("*", F.lit(None).cast("string").alias(out_col)).schema)
