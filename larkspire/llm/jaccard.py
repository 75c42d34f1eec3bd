"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least THRESHOLD, as components.

Sets are deduplicated first: a node is a distinct set (known by a 64-bit hash), and copies share their node. Linked nodes
are found with count vectors. The shingles of a set are hashed into groups, and

* the groups' counts are its point in a space of DIMS dimensions. The sum of the coordinates' minima bounds an overlap
  from above, for two points and for two boxes of points. R-trees of points are joined with themselves, box pair by box
  pair from the root down (Trees.pairs), and only pairs of points that the bound leaves are verified on their sets;
* which points a tree is loaded with is decided by a finer grouping. Two linked sets of n <= m shingles differ in r =
  (n + m) / 9 of them at most, so with more than r groups that hold something, one of them holds the same shingles in
  both. A signature (group, its shingles) is therefore shared by every linked pair, whatever the rest of the corpus, and
  each run of nodes with one signature, of two nodes or many thousands, is a tree. One tree over everything would be right
  too, but in high dimensions its upper boxes overlap so much that it prunes nothing and its cost grows with the square of
  the corpus.

Runs of near copies would cost the square of their size, so links are found in rounds. In the first each node is
verified against one node of its runs; what is linked is contracted, and runs within one component are done. The runs
that still hold several components go through the trees, where boxes of one component are not paired: first a forest of
the likeliest pairs is verified, which joins most of what belongs together, and in the last round every pair that is left.
A run of more than BLOCK nodes is dealt in pairs of blocks, those of its most frequent component against the others only,
so no task holds a whole run. No pair is dropped, capped or sampled on the way: the components are exact.

Shingles, points and signatures are made in one pass over the texts. Signatures travel as packed arrays, a row for each
task and part, and parts are sorted where they are read, one to a task.

Null, empty and blank texts have the empty set: n_shingles 0, linked with nothing, not even each other. Repeated rows and
rows of one doc_id with different texts are documents of their own; rows without doc_id belong to components but never
name one. Very long texts cost memory in proportion to their length alone. An empty table gives an empty result. Extra
columns, whatever their names, are ignored here and kept by representatives().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspire.llm.common import discard, ints, keeps, key, keyed, mapped, shuffle_partitions, stored

WORDS = 5
PERCENT = 80
DIMS = 256
#: Entries of a tree's leaf, and children of its inner nodes.
FAN = 8
BLOCK = 4096
SLICE = 20_000
PAIRS = 200_000
#: After the first: all but the last verify a forest of likely pairs, the last all pairs that are left.
ROUNDS = 3
FLUSH = 600_000
#: Tables of more bytes are joined by a shuffle instead of being broadcast. Of a row of keys, and of one with a point.
BROADCAST_BYTES, KEYS, POINT = 16 << 20, 16, 300
CACHE = 100_000
#: Sets of which a task remembers that it has signed them (in a table of fixed size, the last one of each place).
SEEN = 1 << 18

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE and len(word) <= 40:
            self[word] = h
        return h


_words = _WordHashes()
_FACTORS = [_U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WORDS)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.empty(0, _U)
    h = np.fromiter(map(_words.__getitem__, found), _U, len(found))
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, min(len(h), words), _U)
        for i in range(min(words, len(h))):
            total += h[i : i + n] * _FACTORS[i % WORDS] + _U(i)
    out = _mix(total)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def node_of(s: np.ndarray) -> int:
    """The set's name."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([_mix(s + _U(11)).sum(dtype=_U) + _U(len(s))]))[0].view(np.int64))


def point(s: np.ndarray) -> bytes:
    v = np.bincount((s >> _U(5)).astype(np.int64) % DIMS, minlength=DIMS)
    most = v.max(initial=0)
    return v.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _points(raw) -> np.ndarray:
    """Points as rows of the narrowest type that holds them all."""
    wide = max((len(b) // DIMS for b in raw), default=1)
    return np.array([np.frombuffer(b, f"<u{len(b) // DIMS}") for b in raw], f"<u{wide}").reshape(-1, DIMS)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of the coordinates' minima, row by row."""
    return np.minimum(x, y).sum(1, dtype=np.int64)


def _differ(n, m, percent: int = PERCENT):
    """How many shingles linked sets of n and m shingles differ in at most."""
    return (n + m) * (100 - percent) // (100 + percent)


def linked(overlap, n, m, percent: int = PERCENT):
    return 100 * overlap >= percent * (n + m - overlap)


def _classes() -> list[int]:
    """Bounds of the size classes; a pair belongs to the class of its larger set."""
    out = [4]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


_BOUNDS = np.array(_classes())


def signatures(s: np.ndarray) -> np.ndarray:
    """Of the first groups that hold two shingles or more, in each class in which the set may have a partner.

    The first groups are as many as it takes for one more than a partner can spoil: of two linked sets the one that
    needs fewer groups has at least one of them in common with the other. A group of one shingle would do as well, but
    what it holds is often a passage that many documents share. Sets that have too few groups of two give the signatures
    of all their groups besides, and if these are too few, those of single shingles: two such sets meet there.
    """
    n = len(s)
    largest = n * 100 // PERCENT
    if largest < 5 or n < 4:
        return np.empty(0, _U)  # sets so small are linked with equal sets only
    m, out = _mix(s + _U(3)), []
    for c in range(int(np.searchsorted(_BOUNDS, max(n, 5))), int(np.searchsorted(_BOUNDS, largest)) + 1):
        top = int(_BOUNDS[c])
        groups = -(-30 * top // 100) + 4
        g = (s >> _U(13)) % _U(groups)
        order = np.argsort(g, kind="stable")
        g = g[order]
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        need = _differ(n, min(largest, top)) + 1
        with np.errstate(over="ignore"):
            found = _mix(_mix(np.add.reduceat(m[order], new) + _U(c + 1)) ^ _mix(g[new] + _U(1 << 20)))
            several = found[np.diff(np.append(new, n)) > 1]
            out.append(several[:need])
            if len(several) < need:
                out.append(_mix(found[:need] + _U(5)))
                if len(found) < need:
                    out.append(_mix(m + _mix(np.array([c + (1 << 30)], _U))))
    return np.concatenate(out)


class _Level:
    """Boxes of the trees that have several below: where their children begin, the largest counts, sizes and labels in them."""

    def __init__(self, tree, starts, high, least, most, low_label, high_label):
        self.tree, self.starts, self.high, self.least, self.most = tree, starts, high, least, most
        self.low_label, self.high_label = low_label, high_label


def _grouped(tree: np.ndarray, fan: int) -> np.ndarray:
    """Where groups of at most fan neighbours of one tree begin."""
    first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    place = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
    return np.flatnonzero(place % fan == 0)


class Trees:
    """Bulk-loaded R-trees of count vectors, one for each run: its entries sorted by label and size, fan of them to a leaf, fan boxes to a box above, up to one root.

    points and labels are those of the distinct nodes, entry e stands for node at[e] and is in tree[e] (ascending).
    """

    def __init__(self, points: np.ndarray, labels: np.ndarray, at: np.ndarray, tree: np.ndarray, fan: int = FAN):
        self.points, self.labels, self.total = points, labels, points.sum(1, dtype=np.int64)
        self.at = at = at[np.lexsort((self.total[at], labels[at], tree))]
        self.levels: list[_Level] = []
        if not len(at):
            return
        starts = _grouped(tree, fan)
        size, label = self.total[at], labels[at]
        high = np.empty((len(starts), points.shape[1]), points.dtype)
        for i in range(0, len(starts), 1024):
            a, b = starts[i], starts[i + 1024] if i + 1024 < len(starts) else len(at)
            high[i : i + 1024] = np.maximum.reduceat(points[at[a:b]], starts[i : i + 1024] - a, axis=0)
        now = _Level(tree[starts], starts, high, *(f.reduceat(x, starts) for f, x in ((np.minimum, size), (np.maximum, size), (np.minimum, label), (np.maximum, label))))
        self.levels.append(now)
        while True:
            several = np.concatenate([now.tree[1:] == now.tree[:-1], [False]]) | np.concatenate([[False], now.tree[1:] == now.tree[:-1]])
            if not several.any():
                break
            of = np.flatnonzero(several)
            starts = _grouped(now.tree[of], fan)
            parts = [f.reduceat(x[of], starts, axis=0) for f, x in ((np.maximum, now.high), (np.minimum, now.least), (np.maximum, now.most), (np.minimum, now.low_label), (np.maximum, now.high_label))]
            now = _Level(now.tree[of][starts], of[starts], *parts)
            self.levels.append(now)

    def _ends(self, k: int) -> np.ndarray:
        """Where the children of the boxes of a level end: those of one box follow each other."""
        below = len(self.at) if k == 0 else len(self.levels[k - 1].tree)
        ends = np.append(self.levels[k].starts[1:], below)
        if k:  # children of trees with one box lie between
            tree, last = self.levels[k - 1].tree, np.searchsorted(self.levels[k - 1].tree, self.levels[k].tree, side="right")
            ends = np.minimum(ends, last)
        return ends

    def pairs(self, percent: int = PERCENT, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes with different labels that meet in a leaf pair which the bound doesn't rule out; some `most` at a time, not yet bounded themselves."""
        work = []
        for k, level in enumerate(self.levels):
            above = self.levels[k + 1].tree if k + 1 < len(self.levels) else np.empty(0, level.tree.dtype)
            roots = np.flatnonzero(~np.isin(level.tree, above))
            work.append((k, roots, roots))
        ends = [self._ends(k) for k in range(len(self.levels))]
        step = max(1, most // (FAN * FAN))
        while work:
            k, a, b = work.pop()
            if len(a) > step:
                work += [(k, a[step:], b[step:]), (k, a[:step], b[:step])]
                continue
            level = self.levels[k]
            keep = (100 * level.most[a] >= percent * level.least[b]) & (100 * level.most[b] >= percent * level.least[a])
            keep &= (level.low_label[a] != level.high_label[a]) | (level.low_label[b] != level.high_label[b]) | (level.low_label[a] != level.low_label[b])
            a, b = a[keep], b[keep]
            apart = a != b
            bound = np.full(len(a), np.iinfo(np.int64).max // 1000)
            bound[apart] = _shared(level.high[a[apart]], level.high[b[apart]])
            keep = (100 + percent) * bound >= percent * (level.least[a] + level.least[b])
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            na, nb = ends[k][a] - level.starts[a], ends[k][b] - level.starts[b]
            n = na * nb
            pair = np.repeat(np.arange(len(a)), n)
            i, j = np.divmod(np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n), nb[pair])
            x, y = level.starts[a][pair] + i, level.starts[b][pair] + j
            keep = (a[pair] != b[pair]) | ((x < y) if k == 0 else (x <= y))
            x, y = x[keep], y[keep]
            if k:
                work.append((k - 1, x, y))
                continue
            x, y = self.at[x], self.at[y]
            other = self.labels[x] != self.labels[y]
            yield x[other], y[other]


def _small(df: DataFrame, width: int) -> DataFrame:
    """A stored table, broadcast if its rows of width bytes have no more than BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def _shingled(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Of one pass over the texts: each document's node, number of shingles and point; and signatures with their nodes, packed for each part. A set that a task has just met is not signed again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keeps("jaccard", _words.clear)
        seen = np.zeros(SEEN, np.int64)
        nodes, sigs, held = [], [], 0

        def flush() -> pd.DataFrame:
            counts = np.array([len(x) for x in sigs])
            sig, node = np.concatenate(sigs), np.repeat(np.array(nodes, np.int64), counts)
            part = ((sig >> _U(48)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, _pack(sig[order[a:b]], node[order[a:b]])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            none = ints([None] * len(rows))
            return pd.DataFrame({"doc_id": none, "node": none, "n": none, "point": None, "part": ints(r[0] for r in rows), "packed": [r[1] for r in rows]})

        for pdf in batches:
            sets = [shingles(t if isinstance(t, str) else None) for t in pdf["text"]]
            names = [node_of(s) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "doc_id": ints(map(keyed, pdf["doc_id"])), "node": ints(names), "n": ints(map(len, sets)),
                "point": [point(s) if len(s) else None for s in sets], "part": ints([None] * len(sets)), "packed": None,
            })
            for node, s in zip(names, sets, strict=True):
                if node is not None and seen[node & (SEEN - 1)] != node:
                    seen[node & (SEEN - 1)] = node
                    x = signatures(s)
                    if len(x):
                        nodes.append(node)
                        sigs.append(x)
                        held += len(x)
                if held >= FLUSH:
                    yield flush()
                    nodes, sigs, held = [], [], 0
        if held:
            yield flush()

    schema = "doc_id long, node long, n long, point binary, part int, packed binary"
    both = stored(mapped(docs.select(key(F.col("doc_id")).alias("doc_id"), "text"), run, schema, "jaccard"), "shingled")
    return both.where("part IS NULL").select("doc_id", "node", "n", "point"), both.where("part IS NOT NULL").select("part", "packed")


def _pack(sig: np.ndarray, node: np.ndarray) -> bytes:
    """48 bits of each signature (the part has the rest) and its node, a node once for each stretch of its signatures."""
    new = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
    count = np.diff(np.append(new, len(node))).astype("<u4")
    low = (sig & _U(0xFFFFFFFF)).astype("<u4").tobytes() + ((sig >> _U(32)) & _U(0xFFFF)).astype("<u2").tobytes()
    return np.array([len(new), len(sig)], "<u8").tobytes() + node[new].astype("<i8").tobytes() + count.tobytes() + low


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.frombuffer(raw, "<u8", 2).tolist()
    node, count = np.frombuffer(raw, "<i8", k, 16), np.frombuffer(raw, "<u4", k, 16 + 8 * k)
    at = 16 + 12 * k
    sig = np.frombuffer(raw, "<u4", n, at).astype(_U) | (np.frombuffer(raw, "<u2", n, at + 4 * n).astype(_U) << _U(32))
    return sig, np.repeat(node, count)


def _sorted_runs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, node) of the signatures with two nodes or more, and where runs begin (with the end)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]) if len(sig) else np.empty(0, bool)
    sig, node = sig[keep], node[keep]
    new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.append(new, len(sig)))
    many = np.repeat(size > 1, size)
    starts = np.concatenate([[0], np.cumsum(size[size > 1])])
    return sig[many], node[many], starts.astype(np.int64)


def _runs(packed: DataFrame, parts: int) -> DataFrame:
    """Of each part its runs, packed; runs of equal members are kept once, with their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[int, list] = {}
        for pdf in batches:
            for p, raw in zip(pdf["part"], pdf["packed"], strict=True):
                by.setdefault(int(p), []).append(_unpack(raw))
        for p in list(by):
            got = by.pop(p)
            _, node, starts = _sorted_runs(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            del got
            if not len(node):
                continue
            with np.errstate(over="ignore"):
                name = np.add.reduceat(_mix(node.view(_U) + _U(17)), starts[:-1])  # runs with equal members have equal names
            size = np.diff(starts)
            _, first, times = np.unique(name, return_index=True, return_counts=True)
            weight = np.zeros(len(size), "<u4")
            weight[first] = times
            weight = np.repeat(weight, size)
            keep = weight > 0
            yield pd.DataFrame({"part": [p], "packed": [np.repeat(name, size)[keep].astype("<u8").tobytes() + node[keep].astype("<i8").tobytes() + weight[keep].tobytes()]})

    return mapped(packed.repartitionById(parts, F.col("part")), run, "part int, packed binary")


def _read_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each member the run's name, its node and how many runs have these members; then where runs begin (with the end)."""
    k = len(raw) // 20
    weight = np.frombuffer(raw, "<u4", k, 16 * k)
    name, node = np.frombuffer(raw, "<u8", k), np.frombuffer(raw, "<i8", k, 8 * k)
    new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if k else np.empty(0, np.int64)
    return name.view(np.int64), node, weight, np.append(new, k)


def _open_runs(runs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """run, node, label of the members of the runs that hold two labels or more."""
    schema = "run long, node long, label long"

    def rows(known, open_only: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for raw in pdf["packed"]:
                    name, node, _, starts = _read_runs(raw)
                    label = _named(known, node)
                    if open_only:
                        size = np.diff(starts)
                        keep = np.repeat(np.minimum.reduceat(label, starts[:-1]) != np.maximum.reduceat(label, starts[:-1]), size)
                        name, node, label = name[keep], node[keep], label[keep]
                    for a in range(0, len(name), 200_000):
                        yield pd.DataFrame({"run": name[a : a + 200_000], "node": node[a : a + 200_000], "label": label[a : a + 200_000]})

        return run

    if labels is None or labels.count() * KEYS <= BROADCAST_BYTES:
        return mapped(runs, rows(_known(labels), True), schema)
    all_rows = mapped(runs, rows(None, False), schema).drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("run", "node", "label")
    several = all_rows.groupBy("run").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("run")
    return all_rows.join(several, "run", "left_semi")


def _neighbours(runs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """A pair for each node that isn't of the least label in some of its runs: with the first node of that label with which it shares most signatures."""
    schema = "a long, b long, times long"

    def least(name, node, label, weight) -> pd.DataFrame:
        order = np.lexsort((node, label, name))
        name, node, label, weight = name[order], node[order], label[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.empty(0, np.int64)
        size = np.diff(np.append(new, len(name)))
        other = label != np.repeat(label[new], size)
        a, b, w = node[other], np.repeat(node[new], size)[other], weight[other].astype(np.int64)
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        return pd.DataFrame({"a": a[first], "b": b[first], "times": np.add.reduceat(w, first) if len(first) else w})

    if labels is None or labels.count() * KEYS <= BROADCAST_BYTES:
        known = _known(labels)

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for raw in pdf["packed"]:
                    name, node, weight, _ = _read_runs(raw)
                    yield least(name, node, _named(known, node), weight)

        found = mapped(runs, packed, schema)
    else:
        rows = _open_runs(runs, labels)
        w = Window.partitionBy("run").orderBy("label", "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = rows.withColumn("f", F.first(F.struct("label", "node")).over(w)).where("label <> f.label").select(F.col("node").alias("a"), F.col("f.node").alias("b"), F.lit(1).cast("long").alias("times"))
    pairs = found.groupBy("a", "b").agg(F.sum("times").alias("times"))
    return pairs.groupBy("a").agg(F.max(F.struct("times", F.negative("b").alias("b"))).alias("m")).select("a", F.negative("m.b").alias("b"))


def _known(labels: DataFrame | None):
    """The labels, broadcast as two sorted arrays; their number has been checked."""
    if labels is None:
        return None
    t = labels.select("node", "label").toArrow()
    nodes, names = (t.column(i).to_numpy() for i in range(2))
    order = np.argsort(nodes)
    return labels.sparkSession.sparkContext.broadcast((nodes[order], names[order]))


def _named(known, node: np.ndarray) -> np.ndarray:
    if known is None or not len(known.value[0]):
        return node
    nodes, names = known.value
    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
    return np.where(nodes[at] == node, names[at], node)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose points allow a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = _points(pdf["pa"]), _points(pdf["pb"])
                good = linked(_shared(x, y), x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64), percent)
                yield pdf.loc[good, ["a", "b"]]

    some = points.join(_small(pairs, KEYS), F.col("node") == F.col("a")).select("a", "b", F.col("point").alias("pa"))
    some = stored(some, "points-a", (pairs,))
    full = points.join(_small(some, POINT), F.col("node") == F.col("b")).select("a", "b", "pa", F.col("point").alias("pb"))
    out = stored(mapped(full, run, "a long, b long"), "pairs", (some,))
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are linked, as a stored table. A set travels once for each pair in which it is a, and once for each salt of the pairs in which it is b."""
    spark = pairs.sparkSession
    salts = 16
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    left = sets.join(_small(dealt, KEYS), F.col("node") == F.col("a")).select("b", "salt", F.lit(1).alias("role"), "a", "items")
    centres = stored(dealt.select("b", "salt").distinct(), "centres")
    right = sets.join(_small(centres, KEYS), F.col("node") == F.col("b")).select("b", "salt", F.lit(0).alias("role"), F.lit(0).cast("long").alias("a"), "items")
    n = shuffle_partitions(spark)
    rows = left.unionByName(right).repartition(n, "b", "salt").sortWithinPartitions("b", "salt", "role")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, of = None, None
        for pdf in batches:
            out = []
            for b, salt, role, a, raw in zip(pdf["b"], pdf["salt"], pdf["role"], pdf["a"], pdf["items"], strict=True):
                s = np.frombuffer(raw, "<u8")
                if role == 0:
                    centre, of = s, (b, salt)
                elif of == (b, salt):
                    overlap = len(np.intersect1d(s, centre, assume_unique=True))
                    if linked(overlap, len(s), len(centre), percent):
                        out.append((int(a), int(b)))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return stored(mapped(rows, run, "a long, b long"), "links", (centres, sets, pairs))


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """node and label (the smallest node that it is connected with) of all nodes in edges (a, b): large-star and small-star steps, each a table in the shared folder."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.where("a <> b").distinct()
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        star = small.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = stored(star, name)
        same = new.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(new, ["a", "b"], "left_anti").isEmpty()
        discard(now)
        now = new
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _tree_pairs(rows: DataFrame, points: DataFrame, forest: bool = False) -> DataFrame:
    """Pairs of nodes with different labels that meet in a run's tree and pass the bound, as a stored table; or of these a forest over the labels, likeliest pairs first."""
    members = stored(rows, "open")
    if members.isEmpty():
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    by = members.groupBy("run", "label").count().groupBy("run").agg(F.sum("count").alias("size"), F.max(F.struct("count", "label")).alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    big = by.where(F.col("size") > BLOCK).select("run", F.col("top.label").alias("top"), blocks(F.col("top.count")).alias("of_top"), blocks(F.col("size") - F.col("top.count")).alias("of_rest"))
    big = stored(big, "large-runs")
    dealt = members.join(_small(big, 2 * KEYS), "run", "left")
    t, r = F.col("of_top"), F.col("of_rest")
    place = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    # Block i of the most frequent label meets block j of the others in cell i * of_rest + j; the others' blocks i <= j meet in one of the cells after these.
    top = F.transform(F.sequence(F.lit(0), r - 1), lambda j: place(t) * r + j)
    rest = F.concat(F.transform(F.sequence(F.lit(0), t - 1), lambda i: i * r + place(r)), F.transform(F.sequence(F.lit(0), r - 1), lambda j: t * r + F.least(j, place(r)) * r + F.greatest(j, place(r))))
    cells = F.when(t.isNull(), F.array(F.lit(0))).when(F.col("label") == F.col("top"), top).otherwise(rest)
    placed = dealt.select("run", F.explode(cells).alias("block"), "node", "label")
    wanted = stored(members.select("node").distinct(), "open-nodes")
    some = stored(points.join(_small(wanted, KEYS), "node", "left_semi"), "open-points", (wanted,))
    full = placed.join(_small(some, POINT), "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= SLICE:
                pdf = pd.concat(held)
                new = _begins(pdf["run"].to_numpy(), pdf["block"].to_numpy())
                yield from _run_pairs(pdf.iloc[: new[-1]], forest)
                held = [pdf.iloc[new[-1] :]]  # the last run may go on
                size = len(held[0])
        if held:
            yield from _run_pairs(pd.concat(held), forest)

    found = mapped(full.repartition(shuffle_partitions(rows.sparkSession), "run", "block").sortWithinPartitions("run", "block"), run, "a long, b long").distinct()
    return stored(found, "pairs", (members, big, some))


def _begins(run: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (block[1:] != block[:-1])])) if len(run) else np.zeros(1, np.int64)


def _run_pairs(pdf: pd.DataFrame, forest: bool) -> Iterator[pd.DataFrame]:
    """Pairs that the bound leaves in whole runs, each run a tree. At most some PAIRS of them are held at a time."""
    if not len(pdf):
        return
    node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
    names, first, at = np.unique(node, return_index=True, return_inverse=True)
    points, named = _points(pdf["point"].to_numpy()[first]), label[first]
    new = _begins(pdf["run"].to_numpy(), pdf["block"].to_numpy())
    tree = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(pdf))))
    trees = Trees(points, named, at, tree)
    held, n = [], 0

    def near() -> tuple[np.ndarray, np.ndarray]:
        """The pairs once, those that the bound leaves; in a forest's round the forest of them, likeliest pairs first."""
        keys = np.unique(np.concatenate(held))
        x, y = np.divmod(keys, len(names))
        total = trees.total
        x, y = (v[(100 * total[x] >= PERCENT * total[y]) & (100 * total[y] >= PERCENT * total[x])] for v in (x, y))
        most = np.concatenate([_shared(points[x[a : a + 10_000]], points[y[a : a + 10_000]]) for a in range(0, len(x), 10_000)]) if len(x) else np.empty(0, np.int64)
        good = linked(most, total[x], total[y])
        x, y, most = x[good], y[good], most[good]
        if forest and len(x):
            keep = _forest(named[x], named[y], np.argsort(-most / (total[x] + total[y]), kind="stable"))
            x, y = x[keep], y[keep]
        return x, y

    for x, y in trees.pairs():
        held.append(np.unique(np.maximum(x, y) * len(names) + np.minimum(x, y)))
        n += len(held[-1])
        if n >= PAIRS:
            x, y = near()
            if not forest:
                yield _named_pairs(names[x], names[y])
            held, n = ([x * len(names) + y], 0) if forest else ([], 0)
    if held:
        x, y = near()
        yield _named_pairs(names[x], names[y])


def _named_pairs(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})


def _forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """The edges, taken in order, that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(i)
    return out


def _sets(docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """node and items of the nodes in the pairs, made from the texts again, as a stored table. The same set may come from several rows of one doc_id, or of none; that does no harm."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
    wanted = stored(reps.join(_small(nodes, KEYS), "node", "left_semi").select("doc_id").distinct(), "wanted")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = texts.where("doc_id IS NOT NULL").join(_small(wanted, KEYS), "doc_id", "left_semi").unionByName(texts.where("doc_id IS NULL"))

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keeps("jaccard", _words.clear)
        for pdf in batches:
            found = [(node_of(s), s.astype("<u8").tobytes()) for s in map(shingles, pdf["text"]) if len(s)]
            yield pd.DataFrame(found, columns=["node", "items"]).astype({"node": "int64"})

    return stored(mapped(chosen.select("text"), items, "node long, items binary", "jaccard").join(_small(nodes, KEYS), "node", "left_semi"), "sets", (nodes, wanted))


def join(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), set_hash and root (the component's name as a node) of every row."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    owners, packed = _shingled(docs, parts)
    runs = stored(_runs(packed, parts), "signed")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["packed"]:
                yield pd.DataFrame({"node": np.unique(_read_runs(raw)[1])})

    met = stored(mapped(runs, members, "node long").distinct(), "met")
    reps = owners.where("node IS NOT NULL").join(_small(met, KEYS), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("point").alias("point"))
    reps = stored(reps, "nodes", (met,))
    points = reps.select("node", "point")
    edges, labels, links = None, None, []
    for k in range(1 + rounds):
        if k == 0:
            pairs = _bounded(stored(_neighbours(runs, labels), "neighbours"), points)
        else:
            pairs = _tree_pairs(_open_runs(runs, labels), points, forest=k < rounds)
        new = _verified(pairs, _sets(docs, pairs, reps))
        if not new.isEmpty():
            links.append(new)
            edges = new if edges is None else edges.unionByName(new)
            labels = components(edges)
    discard(runs, reps)
    mine = owners.select("doc_id", "n", "node")
    if labels is None:
        rooted = mine.withColumn("root", F.col("node"))
    else:
        rooted = mine.join(_small(labels, KEYS), "node", "left").withColumn("root", F.coalesce("label", "node"))
    firsts = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).where("many > 1").select("root", "first")
    named = rooted.join(_small(stored(firsts, "firsts"), KEYS), "root", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"), F.col("node").alias("set_hash"), "root")


def _node(text: pd.Series) -> pd.Series:
    sets = [shingles(t if isinstance(t, str) else None) for t in text]
    return pd.Series(ints(node_of(s) if len(s) else None for s in sets))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, repeated rows once; where no row of a component has a doc_id, the one of least hash. Rows of the empty set are in no component and stay."""
    found = stored(join(docs.select("doc_id", "text")), "near-duplicates")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    kept_too = found.where("doc_id = component_id").select(F.col("doc_id").alias("__gone"))
    gone = stored(gone.join(kept_too, "__gone", "left_anti").distinct(), "gone")
    named = docs.where("doc_id IS NOT NULL")
    kept = named.join(_small(gone, KEYS), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    twice = stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")), "repeated")
    if not twice.isEmpty():
        same = F.col("doc_id").cast("long") == F.col("__twice")
        once, many = (kept.join(_small(twice, KEYS), same, how) for how in ("left_anti", "left_semi"))
        kept = once.unionByName(_one_each(many, found))
    nameless = docs.where("doc_id IS NULL")
    return kept if nameless.isEmpty() else kept.unionByName(_one_each(nameless, found))


def _one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows that doc_id doesn't tell apart: those that are their component's first (no doc_id in it, or their own), one of each component and doc_id."""
    columns = docs.columns
    node = F.pandas_udf(_node, "long")
    of = found.where("set_hash IS NOT NULL").select(F.col("set_hash").alias("__node"), F.col("root").alias("__root"), F.col("component_id").alias("__first")).distinct()
    rows = docs.withColumn("__node", node(F.col("text"))).join(of, "__node", "left")
    blank = rows.where("__node IS NULL").select(*columns)
    mine = rows.where("__node IS NOT NULL AND __first <=> CAST(doc_id AS long)")
    least = Window.partitionBy("__root").orderBy(F.xxhash64("text"), "text")
    first = mine.withColumn("__at", F.row_number().over(least)).where("__at = 1").select(*columns)
    return first.unionByName(blank)


def digest(docs: DataFrame) -> DataFrame:
    return join(docs).drop("root")
