"""SentencePiece encoding and decoding, and sampled segmentations without replacement.

sampled() draws the k segmentations of a text that a Gumbel top-k draw would give, in falling order of their perturbed
log probability. The lattice has a node for each character and an arc for each vocabulary piece; a piece's weight falls
with its rank in the vocabulary (RANK_POWER, RANK_SHIFT), bytes stand in where no piece fits. With the log partition sum
of what follows, arcs become conditional probabilities, so the bound of a set of segmentations, the largest perturbed
value in it, is exact. The A* search holds sets in a heap by that value: at first the set of all. The best set is split
into the segmentation that has the value (arcs drawn down to the end), and what is left of it: all that leaves that path
at some node. The largest value in there is a Gumbel value for the log of its probability, truncated at the value of the
set it comes from, and when its turn comes, the node and the arc by which it leaves are drawn by their probabilities. So
siblings are never listed and a sample costs one pass over the text. The inclusion score of a segmentation is its
probability of being among the k, given the value of the k + 1-th. Draws are seeded by the row's key, so a row gives the
same samples in whatever task it runs.

Pieces never hold a space mark after another character (checked when a model is loaded), so a text is cut into units
before space marks. Arrow cuts the texts of a batch and numbers what repeats. The lattices of the units that are new in it
are made together, and kept in a bounded table of the worker; when it is full, units that several batches have used stay.
Arcs are drawn only for the nodes that a path comes through.

Null and empty texts have one segmentation, the empty one, with log probability 0 and inclusion 1. Texts with fewer
than k segmentations give all of them, with inclusion 1. Equal rows give equal samples. Texts of any length are read whole
and cost memory in proportion to it. Rows without key are seeded alike. Extra columns are ignored by samples() and kept by
encode() and decode(), but for the one that is named like their output. An empty table gives an empty
result. Decoding gives back the text, but for texts that hold the space mark itself, which comes back as a space.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspire.llm.common import bounded_batches, ints, keeps, key, keyed, mapped

MARK = "▁"
SAMPLES = 2
RANK_POWER, RANK_SHIFT = 1.0, 2.7
BYTE_LOG, UNUSUAL_LOG = -12.0, -24.0
TABLE_ARCS = 8_000_000
#: Characters whose paths are drawn together.
BATCH_CHARS = 400_000
#: So many units at least are walked side by side; fewer, long ones one by one.
ABREAST = 16

_BITS, _BASE, _MIX = 22, np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
_SAMPLE, _FIRST, _SECOND, _ALL = 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * 1_000_003 + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


def _slot(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * _MIX) >> np.uint64(64 - _BITS)


_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_loaded: dict[str, Model] = {}


class _Stream:
    """Random numbers of a row, from its seed."""

    def __init__(self, seed: int):
        self.seed, self.n = seed, 0

    def random(self) -> float:
        self.n += 1
        return (xxhash.xxh3_64_intdigest(self.n.to_bytes(8, "little"), self.seed) + 0.5) / 18446744073709551616.0

    def standard_exponential(self) -> float:
        return -math.log(self.random())


class Model:
    """A SentencePiece vocabulary and its lattices."""

    def __init__(self, path: str, table_arcs: int = TABLE_ARCS):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = {}
        rank = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} crosses a space")
                rank += 1
                usual = sp.get_score(i) > -1e6
                self.pieces[piece] = (i, -RANK_POWER * math.log(rank + RANK_SHIFT) if usual else UNUSUAL_LOG)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.written = pa.array(self.bytes_of, pa.large_binary())
        self.ascii = np.array([self.byte_id.get(b, -1 - b) for b in range(0x80)], np.int32)
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.array([_hash(p) for p in self.pieces], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        order = np.argsort(_slot(hashes), kind="stable")
        slots, again = np.unique(_slot(hashes), return_counts=True)
        # Pieces of one slot follow each other; the last one is there as often again as a slot has pieces, so that the step after it leads somewhere.
        self.deepest = int(again.max(initial=1))
        order = np.append(order, np.repeat(order[-1:], self.deepest))
        self.hashes = hashes[order]
        self.hash_id = np.array([i for i, _ in self.pieces.values()], np.int32)[order]
        self.hash_log = np.array([w for _, w in self.pieces.values()])[order]
        self.first_of = np.zeros(1 << _BITS, np.int32)
        self.first_of[slots] = np.cumsum(again) - again
        # By slot: 1 where a piece may be, and 2 where one may begin that is longer.
        self.bits = np.zeros(1 << _BITS, np.uint8)
        self.bits[slots] |= 1
        self.bits[_slot(np.array([_hash(h) for h in {p[:n] for p in self.pieces for n in range(1, len(p))}], np.uint64))] |= 2
        self.limit = table_arcs
        self._room(table_arcs)

    def _room(self, arcs: int) -> None:
        self.units: dict[str, int] = {}
        self.known, self.uses = np.empty((0, 2), np.int64), np.empty(0, np.int32)
        self.used, self.nodes, self.arcs = 0, 0, arcs
        self.heads = np.empty(arcs + 1, np.int32)
        self.size, self.id = np.empty(arcs, np.uint8 if self.longest < 256 else np.int32), np.empty(arcs, np.int32)
        self.log, self.below = np.empty(arcs, np.float64), np.empty(arcs, np.float32)

    def lattices(self, units: list[str]):
        """Of all units: arcs of each; then start and end in the unit, id (below 0: the code point, as -1 minus it, in several bytes), conditional log probability and its running sum at a node, by unit and start."""
        size, cnt, span, ids, log, below = self._lattices(units)
        inside = np.arange(len(cnt)) - np.repeat(np.cumsum(size) - size, size)
        start = np.repeat(inside, cnt)
        count = np.bincount(np.repeat(np.repeat(np.arange(len(units)), size), cnt), minlength=len(units))
        return count, start, start + span, ids, log, below

    def _lattices(self, units: list[str]):
        """Of all units: characters of each; arcs of each character; then length, id, log probability and running sum of each arc, by start and length."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        n = len(chars)
        left = np.repeat(np.cumsum(size), size) - np.arange(n)  # characters up to the unit's end
        at, h = np.arange(n), np.zeros(n, np.uint64)
        cnt, found, odd = np.ones(n, np.int32), [], at
        for length in range(1, self.longest + 1):
            with np.errstate(over="ignore"):
                h = h * _BASE + chars[at + (length - 1)]
            slot = _slot(h).view(np.int64)
            bits = self.bits.take(slot)
            hit = np.flatnonzero(bits & 1)
            i, g, where = at.take(hit), h.take(hit), self.first_of.take(slot.take(hit))
            miss = np.flatnonzero(self.hashes.take(where) != g)
            for _ in range(self.deepest - 1):
                where[miss] += 1
                miss = miss[self.hashes[where[miss]] != g[miss]]
            if len(miss):
                i, where = np.delete(i, miss), np.delete(where, miss)
            if length == 1:  # every character has one arc of its own: a piece or its bytes
                found.append((i, 0, where))
                single = np.zeros(n, bool)
                single[i] = True
                odd = np.flatnonzero(~single)
            else:
                nth = cnt.take(i)
                cnt[i] = nth + 1
                found.append((i, nth, where))
            go = np.flatnonzero((bits & 2).astype(bool) & (left.take(at) > length))
            if not len(go):
                break
            at, h = at.take(go), h.take(go)
        tails = np.cumsum(cnt, dtype=np.int64)
        head, arcs = tails - cnt, int(tails[-1]) if n else 0
        span, piece = np.ones(arcs, np.int64), np.zeros(arcs, np.int32)
        for length, (i, nth, where) in enumerate(found, 1):
            to = head.take(i) + nth
            span[to] = length
            piece[to] = where
        ids, weight = self.hash_id.take(piece), self.hash_log.take(piece)
        c, to = chars[odd], head[odd]
        ids[to] = np.where(c < 0x80, self.ascii[np.minimum(c, 0x7F)], -1 - c.astype(np.int32))
        weight[to] = BYTE_LOG * (1.0 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        # Nodes nearest to their unit's end first; an arc to the end leads to node n.
        far = int(left.max(initial=0))
        node = np.argsort(left.astype(np.uint16) if far < 1 << 16 else left, kind="stable")
        many = cnt.take(node)
        first = np.cumsum(many, dtype=np.int64) - many
        order = np.repeat(head.take(node) - first, many) + np.arange(arcs)
        reach, to = np.repeat(left.take(node), many), np.repeat(node, many)
        step = span.take(order)
        to += step
        to[step == reach] = n
        weight, total = weight.take(order), np.zeros(n + 1)
        levels = np.searchsorted(left.take(node), np.arange(1, far + 2))
        bounds = np.append(first, arcs).take(levels)
        for a, b, na, nb in zip(bounds[:-1].tolist(), bounds[1:].tolist(), levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            if a < b:
                v, each, new = weight[a:b], many[na:nb], first[na:nb] - a
                v += total.take(to[a:b])
                most = np.maximum.reduceat(v, new)
                sums = most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, each)), new))
                total[node[na:nb]] = sums
                v -= np.repeat(sums, each)
        log = np.empty(arcs)
        log[order] = weight
        run, nth, more = np.exp(log), 1, np.flatnonzero(cnt > 1)
        while len(more):
            i = head.take(more) + nth
            run[i] += run.take(i - 1)
            nth += 1
            more = more[cnt.take(more) > nth]
        run[tails - 1] = 2.0  # the last arc of a node takes what rounding leaves
        return size, cnt, span, ids, log, run

    def _add(self, size: np.ndarray, cnt: np.ndarray, *arrays: np.ndarray) -> None:
        """Puts lattices of units, numbered next, into the table."""
        a, nodes = self.used, self.nodes
        tails = a + np.cumsum(cnt, dtype=np.int64)
        b = int(tails[-1]) if len(tails) else a
        for mine, made in zip((self.size, self.id, self.log, self.below), arrays, strict=True):
            mine[a:b] = made
        self.heads[nodes] = a
        self.heads[nodes + 1 : nodes + 1 + len(cnt)] = tails
        self.used, self.nodes = b, nodes + len(cnt)
        self.known = np.concatenate([self.known, np.column_stack([nodes + np.cumsum(size) - size, size])])
        self.uses = np.append(self.uses, np.zeros(len(size), np.int32))

    def _evict(self, numbers: np.ndarray, arcs: int) -> np.ndarray:
        """A table with room for so many arcs: units stay that more than one batch has used since the last time, if they fill half the table at most, and those of these numbers, which get new ones."""
        first, size = self.known.T
        stay = self.uses > 1
        if (self.heads[first + size] - self.heads[first])[stay].sum() > self.limit // 2:
            stay[:] = False
        stay[numbers[numbers >= 0]] = True
        first, size = first[stay], size[stay]
        nodes = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        heads = self.heads.take(nodes).astype(np.int64)
        cnt = self.heads.take(nodes + 1) - heads
        index = np.repeat(heads - (np.cumsum(cnt) - cnt), cnt) + np.arange(int(cnt.sum()))
        arrays = [x.take(index) for x in (self.size, self.id, self.log, self.below)]
        place = np.append(np.where(stay, np.cumsum(stay) - 1, -1), -1)
        now = place.tolist()
        units = {u: now[n] for u, n in self.units.items() if now[n] >= 0}
        self._room(max(self.limit, len(index) + arcs))
        self._add(size, cnt, *arrays)
        self.units = units
        return place[numbers]

    @staticmethod
    def split(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Keys of the texts' units, the key of each unit, and each text's number of units. A key without mark stands for the unit with one before it."""
        plain = np.array([bool(t) and not (MARK in t or "  " in t or t[0] == " " or t[-1] == " ") for t in texts], bool)
        try:
            words = pc.split_pattern(pa.array([t for t, p in zip(texts, plain.tolist(), strict=True) if p], pa.large_string()), " ")
        except UnicodeEncodeError:  # lone surrogates
            plain[:] = False
            words = pc.split_pattern(pa.array([], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        keys, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = np.diff(words.offsets.to_numpy())
        odd = [i for i in np.flatnonzero(~plain).tolist() if texts[i]]
        if odd:
            units = [_UNIT.findall(MARK + texts[i].replace(" ", MARK)) for i in odd]
            sizes[odd] = list(map(len, units))
            mine, of = np.repeat(plain, sizes), np.empty(int(sizes.sum()), np.int64)
            of[mine] = coded.indices.to_numpy()
            of[~mine] = np.arange(len(keys), len(keys) + sum(map(len, units)))
            keys = keys + [u for x in units for u in x]
        return keys, of, sizes

    def places(self, units: list[str]) -> np.ndarray:
        """First node and number of characters of each unit in the table."""
        numbers = np.fromiter(map(self.units.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            again = [units[i] for i in missing.tolist()]
            new = list(dict.fromkeys(again))
            size, cnt, *arrays = self._lattices([u if MARK in u else MARK + u for u in new])
            if self.used + len(arrays[0]) > self.arcs:
                numbers = self._evict(numbers, len(arrays[0]))
            self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
            self._add(size, cnt, *arrays)
            numbers[missing] = list(map(self.units.__getitem__, again))
        self.uses[numbers] += 1
        return self.known[numbers]

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        """Piece ids of a path's arcs; what is written in bytes takes one id a byte."""
        odd = np.flatnonzero(arcs < 0)
        if not len(odd):
            return arcs.astype("<u4")
        made = [chr(-1 - c).encode("utf-8", "replace") for c in arcs[odd].tolist()]
        many, size = np.fromiter(map(len, made), np.int64, len(made)), np.ones(len(arcs), np.int64)
        size[odd] = many
        out, data = np.repeat(arcs, size), b"".join(made)
        to = np.repeat((np.cumsum(size) - size)[odd] - (np.cumsum(many) - many), many) + np.arange(len(data))
        out[to] = list(map(self.byte_id.__getitem__, data))
        return out.astype("<u4")

    def decodes(self, ids: np.ndarray, text: str) -> bool:
        """Whether ids are the text, without making it piece by piece."""
        if not text:
            return not len(ids)
        return self.written.take(pa.array(ids)).buffers()[2].to_pybytes() == b" " + text.encode("utf-8", "replace")

    def decode(self, ids) -> str:
        of = self.bytes_of
        return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def sampled(self, text: str | None, key, k: int = SAMPLES) -> list[tuple[np.ndarray, float, float, float]]:
        """(ids, log probability, perturbed value, inclusion score) of k segmentations at most, best first."""
        return next(self.batch([text], [key], k))

    def batch(self, texts: list[str | None], keys: list, k: int = SAMPLES) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
        """What sampled() gives for each text; the paths of all texts are drawn together."""
        units, of, sizes = self.split(texts)
        first, chars = self.places(units).take(of, 0).T.copy()
        ends = np.cumsum(chars)
        begins = ends - chars
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        seeds = np.array([xxhash.xxh3_64_intdigest(f"{key}") for key in keys], np.uint64)
        with np.errstate(over="ignore"):
            seed = np.repeat(seeds, sizes) + (begins - np.repeat(bounds[:-1], sizes)).astype(np.uint64) * _MIX
        drawn = [self._walk(seed, s, first, begins, ends, bounds) for s in range(k)] if len(ends) else []
        for i, text in enumerate(texts):
            if not text:
                yield [(np.empty(0, "<u4"), 0.0, 0.0, 1.0)]
                continue
            found, kappa = self._search(i, k, drawn, bounds, first, begins, ends, seed, _Stream(int(seeds[i])))
            out = []
            for path, sums, value in found:
                total = float(sums[-1])
                inclusion = 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(700.0, total - kappa)))
                out.append((self.ids(self.id.take(path)), total, value, inclusion))
            yield out

    def _draw(self, seed: np.ndarray, s: int, node: np.ndarray) -> np.ndarray:
        """An arc for each node by the s-th draw, from the seed at its place in the text."""
        with np.errstate(over="ignore"):
            z = seed + np.uint64((s + 1) * _SAMPLE & _ALL)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(_FIRST)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(_SECOND)
        u = (z >> np.uint64(41)).astype(np.float32) * np.float32(1.0 / (1 << 23))
        arc = self.heads.take(node).astype(np.int64)
        over = np.flatnonzero(self.below.take(arc) <= u)
        while len(over):
            now = arc.take(over) + 1
            arc[over] = now
            over = over[self.below.take(now) <= u.take(over)]
        return arc

    def _draw_one(self, seed: int, s: int, node: int) -> int:
        """What _draw() gives for one node."""
        z = seed + (s + 1) * _SAMPLE & _ALL
        z = (z ^ z >> 30) * _FIRST & _ALL
        z = (z ^ z >> 27) * _SECOND & _ALL
        u, arc = (z >> 41) / (1 << 23), int(self.heads[node])
        while self.below[arc] <= u:
            arc += 1
        return arc

    def _walk(self, seed, s, node, now, ends, bounds):
        """The s-th draw's path through every unit: the characters where its arcs start, the arcs, and where the texts' arcs begin."""
        n = int(ends[-1])
        arcs, on, last = np.empty(n, np.int64), np.zeros(n, bool), ends
        while len(now) >= ABREAST:
            arc = self._draw(seed, s, node)
            arcs[now] = arc
            on[now] = True
            step = self.size.take(arc).astype(np.int64)
            now = now + step
            more = np.flatnonzero(now < last)
            step = step.take(more)
            now, last, node = now.take(more), last.take(more), node.take(more) + step
            with np.errstate(over="ignore"):
                seed = seed.take(more) + step.view(np.uint64) * _MIX
        for at, end, z, n in zip(now.tolist(), last.tolist(), seed.tolist(), node.tolist(), strict=True):
            while at < end:
                arcs[at] = arc = self._draw_one(z, s, n)
                on[at] = True
                step = int(self.size[arc])
                at, z, n = at + step, z + step * int(_MIX) & _ALL, n + step
        spots = np.flatnonzero(on)
        return spots, arcs.take(spots), np.searchsorted(spots, bounds)

    def _search(self, i, k, drawn, bounds, first, begins, ends, seed, rng):
        """The A* search in text i: k segmentations as (arcs, log probabilities of the prefixes, value), and the k + 1-th value."""
        none = np.empty(0, np.int64)

        def span(spot: int) -> tuple[int, int]:
            """The arcs that start at a character."""
            unit = int(np.searchsorted(ends, spot, side="right"))
            node = int(first[unit]) + spot - int(begins[unit])
            return int(self.heads[node]), int(self.heads[node + 1])

        def down(before: np.ndarray, spots: np.ndarray, sums: np.ndarray, s: int):
            """A segmentation below a prefix by the s-th draw: arcs, where they start, log probabilities of the prefixes."""
            where, arcs, of = drawn[s]
            if not len(before):
                path, spots = arcs[of[i] : of[i + 1]], where[of[i] : of[i + 1]]
                return path, spots, np.cumsum(self.log.take(path))
            at = int(spots[-1]) + int(self.size[before[-1]])
            unit = int(np.searchsorted(ends, spots[-1], side="right"))
            rest, rest_spots = [], []
            while at < ends[unit]:
                inside = at - int(begins[unit])
                rest.append(self._draw_one(int(seed[unit]) + inside * int(_MIX) & _ALL, s, int(first[unit]) + inside))
                rest_spots.append(at)
                at += int(self.size[rest[-1]])
            a, b = int(np.searchsorted(where, at)), of[i + 1]
            path = np.concatenate([before, np.array(rest, np.int64), arcs[a:b]])
            more = np.cumsum(self.log.take(path[len(before) :])) + sums[-1]
            return path, np.concatenate([spots, np.array(rest_spots, np.int64), where[a:b]]), np.concatenate([sums, more])

        def gumbel(mass: float, most: float) -> float:
            """A Gumbel value for a log probability, given that it is at most `most`."""
            v = mass - math.log(rng.standard_exponential())
            if most == math.inf:
                return v
            d = most - v
            return most - max(0.0, d) - math.log1p(math.exp(-abs(d)))

        # What is left of a set: the path it is left around, where its arcs start, the log probabilities of its prefixes, from
        # which node on it may be left, and arcs by which it has been left already (each a set of its own by now).
        heap: list[tuple] = []

        def left(value: float, order: int, path: np.ndarray, spots: np.ndarray, sums: np.ndarray, since: int, gone: frozenset) -> None:
            top = float(sums[since - 1]) if since else 0.0
            rest = -math.expm1(float(sums[-1]) - top) - sum(math.exp((float(sums[t - 1]) if t else 0.0) - top + float(self.log[a])) for t, a in sorted(gone))
            exact = top + math.log(rest) if rest > 1e-9 else self._rest(path, spots, sums, since, gone, span)
            if exact is not None:
                heapq.heappush(heap, (-gumbel(exact, value), order, path, spots, sums, since, gone))

        value = gumbel(0.0, math.inf)
        path, spots, sums = down(none, none, np.empty(0), 0)
        done = [(path, sums, value)]
        left(value, 0, path, spots, sums, 0, frozenset())
        while heap:
            value, order, path, spots, sums, since, gone = heapq.heappop(heap)
            value = -value
            if len(done) == k:
                return done, value
            t, arc = self._leave(path, spots, sums, since, gone, span, rng)
            mine, mine_spots, mine_sums = down(np.append(path[:t], arc), spots[: t + 1], np.append(sums[:t], (sums[t - 1] if t else 0.0) + self.log[arc]), len(done))
            done.append((mine, mine_sums, value))
            left(value, 2 * order + 1, path, spots, sums, since, gone | {(t, arc)})
            left(value, 2 * order + 2, mine, mine_spots, mine_sums, t + 1, frozenset())
        return done, -math.inf

    def _ways(self, path, spots, sums, since, gone, span):
        """(node, arc, log probability) of all ways to leave a path that haven't been taken; only where few are left."""
        for t in range(since, len(path)):
            for a in range(*span(int(spots[t]))):
                if a != path[t] and (t, a) not in gone:
                    yield t, a, (float(sums[t - 1]) if t else 0.0) + float(self.log[a])

    def _rest(self, path, spots, sums, since, gone, span) -> float | None:
        ways = [w for _, _, w in self._ways(path, spots, sums, since, gone, span)]
        return max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)) if ways else None

    def _leave(self, path, spots, sums, since, gone, span, rng) -> tuple[int, int]:
        """The node and arc by which a drawn segmentation leaves the path: with tries over the whole path, then by listing what is left."""
        top = float(sums[since - 1]) if since else 0.0
        all_ways = -math.expm1(float(sums[-1]) - top)
        for _ in range(64 if all_ways > 1e-9 else 0):
            # Leaving before or at node t has the probability 1 - exp(sums[t] - top).
            mark = math.log1p(-rng.random() * all_ways) + top
            t = since + int(np.searchsorted(-sums[since:], -mark, side="left"))
            if t >= len(path):
                continue
            a, b = span(int(spots[t]))
            w = np.exp(self.log[a:b])
            w[path[t] - a] = 0.0
            run = np.cumsum(w)
            if run[-1] <= 0.0:
                continue
            arc = a + int(np.searchsorted(run, rng.random() * run[-1], side="right"))
            if arc < b and (t, arc) not in gone:
                return t, arc
        ways = list(self._ways(path, spots, sums, since, gone, span))
        best = max(ways, key=lambda w: w[2] - math.log(rng.standard_exponential()))
        return best[0], best[1]


def model(path: str) -> Model:
    """One for each worker process, until another operator runs there."""
    keeps("subword", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the library's own best segmentation of each text."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def made(s: pd.Series) -> pd.Series:
        sp = model(path).sp
        return s.map(lambda x: sp.encode(x) if isinstance(x, str) else [])

    return df.withColumn(out, made(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of each array of ids; null ids are the empty text."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def told(s: pd.Series) -> pd.Series:
        m = model(path)
        return s.map(lambda x: m.decode(x) if x is not None else "")

    return df.withColumn(out, told(F.col(ids)))


def samples(docs: DataFrame, path: str, k: int = SAMPLES, doc_id: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """A row a sample: doc_id, sample (from 1), n_pieces, ids_crc32, log_prob, perturbed, inclusion, decodes and the ids.

    The ids are an array, or packed as binary: little-endian unsigned 16-bit numbers (32-bit where the vocabulary is larger).
    """
    schema = f"doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decodes boolean, ids {'binary' if packed else 'array<int>'}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        kind = "<u2" if len(m.bytes_of) <= 1 << 16 else "<u4"
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["t"]]
            keys = list(map(keyed, pdf["d"]))
            at = 0
            while at < len(texts):
                a, n = at, 0
                while at < len(texts) and (at == a or n + len(texts[at]) <= BATCH_CHARS):
                    n += len(texts[at])
                    at += 1
                rows = []
                for d, t, found in zip(keys[a:at], texts[a:at], m.batch(texts[a:at], keys[a:at], k), strict=True):
                    for i, (ids, total, value, inclusion) in enumerate(found, 1):
                        rows.append((d, i, len(ids), zlib.crc32(ids.tobytes()), total, value, inclusion, m.decodes(ids, t), ids.astype(kind).tobytes() if packed else ids.astype(np.int32)))
                out = pd.DataFrame(rows, columns=["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "decodes", "ids"])
                yield out.assign(doc_id=ints(r[0] for r in rows))

    return mapped(docs.select(key(F.col(doc_id)).alias("d"), F.col(text).alias("t")), run, schema, "subword")
