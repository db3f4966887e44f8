"""Sampled segmentations of texts into pieces of a SentencePiece vocabulary, without
replacement, and their decoding.

A text is a lattice: nodes are positions between characters, edges are pieces. A
segmentation is a path, its weight the product of its pieces' weights (a power law over
the vocabulary's ranks, sharpened or flattened by alpha; characters without a piece fall
back to their bytes). Gumbel top-k over all paths gives k distinct samples without
replacement. It is found by best-first search with exact bounds: the weight of
everything below a node is known from a backward pass, so the largest perturbed value in
"all paths that leave the last one at this node" can be drawn at once, truncated by the
value above it. The queue holds one such set for each node of each emitted path; the
best is popped, a path is drawn from it, and the set is split at that path.

No piece crosses a word, so the backward pass runs once for each distinct word of a
batch, and all steps are array operations over the batch. Every random number is a hash
of seed, row key, sample, word and step: results do not depend on how rows are dealt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsefold.llm.common import batches, flat, mix, offsets, ship, slices
from parsefold.llm.tokencount import MARK, MODEL

SAMPLES, ALPHA, SEED = 2, 1.0, 11
_FALLBACK = -18.0  # log weight of a character that falls back to bytes
_P, _Q = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)
_FINE = float(1 << 30)
_SHORT = 32  # characters of a word whose weights are summed as they are


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        own = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any("\n" in self.pieces[i] or MARK in self.pieces[i].lstrip(MARK) for i in own):
            raise ValueError("the vocabulary has pieces across words; whole texts can't be cut")
        order = sorted(own, key=lambda i: (-model.get_score(i), i))
        weight = -alpha * np.log(np.arange(len(order)) + 10.0)
        self.score = np.full(size, -np.inf)
        self.score[order] = weight
        self.chance = np.append(np.exp(self.score), 0.0)  # the last stands for no piece
        self.longest = max(len(self.pieces[i]) for i in own)
        entries: dict[int, int] = {}  # hash of each beginning of a piece -> the piece it is, or -1
        for i in own:
            h, power = 0, 1
            for k, c in enumerate(self.pieces[i]):
                h = (h + (ord(c) * int(_Q) + 1) * power) % (1 << 64)
                power = power * _P % (1 << 64)
                entries[h] = i if k + 1 == len(self.pieces[i]) else entries.get(h, -1)
        self.bits = 22
        keys = np.array(list(entries), np.uint64)
        ids = np.array(list(entries.values()), np.int32)
        self.keys, self.ids = [], []
        for shift in (0, 21, 42):  # what collides in one table goes to the next
            slot = self._slot(keys, shift)
            first = np.unique(slot, return_index=True)[1]
            table, value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32)
            table[slot[first]], value[slot[first]] = keys[first], ids[first]
            self.keys.append(table)
            self.ids.append(value)
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ids = keys[rest], ids[rest]
            if not len(keys):
                break
        else:
            raise ValueError("vocabulary too large for its tables")

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return (mix(h) >> np.uint64(shift) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash: the piece, -1 for the beginning of one, -2 for neither."""
        out = np.full(len(h), -2, np.int32)
        m = mix(h)
        for k, (keys, ids) in enumerate(zip(self.keys, self.ids)):
            slot = (m >> np.uint64(21 * k) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            hit = keys[slot] == h
            out[hit] = ids[slot[hit]]
        return out


_LOADED: dict[tuple[str, float], Vocabulary] = {}
_PARTS = re.compile(f"\n[^{MARK}\n]*|{MARK}*[^{MARK}\n]+|{MARK}+")


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _LOADED:
        _LOADED[path, alpha] = Vocabulary(path, alpha)
    return _LOADED[path, alpha]


def parts_of(text: str) -> list[str]:
    """The words of a text as the lattice sees them: each begins with a mark (a space) or
    a line feed, and no piece reaches from one into the next."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text:
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n")).split(" ")
    return _PARTS.findall(MARK + text.replace(" ", MARK))


class Lattices:
    """The lattices of the distinct words of a batch. Node n is a character of a word; its
    edges, one for each piece that begins there, are begin[n] to begin[n + 1] of the arrays
    size (characters of the piece, less one), piece (-1: bytes of a character that has no
    piece) and chance (of being taken by a path that comes to the node)."""

    def __init__(self, vocabulary: Vocabulary, distinct: list[str]):
        joined = " ".join(distinct) + " "
        self.points = points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(points == 32)
        self.first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        self.length = ends - self.first
        n = len(points)
        value = points.astype(np.uint64) * _Q + _ONE
        nodes, pieces = [], []  # by size of the piece
        alive, h, power = np.flatnonzero(points != 32), np.zeros(n, np.uint64), 1
        for k in range(vocabulary.longest):
            alive = alive[alive + k < n]
            if not len(alive):
                break
            h[alive] += value[alive + k] * np.uint64(power)
            power = power * _P % (1 << 64)
            found = vocabulary.find(h[alive])
            hit = np.flatnonzero(found >= 0) if k else np.arange(len(alive))  # every character has an edge of its own
            nodes.append(alive[hit])
            pieces.append(np.maximum(found[hit], -1))
            alive = alive[found >= -1]
        while len(nodes) > 1 and not len(nodes[-1]):
            nodes, pieces = nodes[:-1], pieces[:-1]
        self.wide = wide = len(nodes)
        chances = [np.where(x >= 0, vocabulary.chance[x], np.exp(_FALLBACK)) for x in pieces]
        left = np.repeat(ends, self.length + 1) - np.arange(n)
        long_ = np.repeat(self.length, self.length + 1) > _SHORT
        below = np.ones(n + wide)  # weight of all paths from a node to its word's end
        short = [np.flatnonzero(~long_[x]) for x in nodes]
        left8 = np.minimum(left, 255).astype(np.uint8)
        by_left = [x[np.argsort(left8[nodes[k][x]], kind="stable")] for k, x in enumerate(short)]
        cuts = [np.searchsorted(left8[nodes[k][x]], np.arange(_SHORT + 2)) for k, x in enumerate(by_left)]
        for d in range(1, min(left.max(), _SHORT) + 1):
            for k in range(min(d, wide)):  # in one order, so that sums do not depend on the batch
                own = by_left[k][cuts[k][d] : cuts[k][d + 1]]
                if len(own):
                    at = nodes[k][own]
                    weight = chances[k][own] * below[at + (k + 1)]
                    below[at] = below[at] + weight if k else weight
        for k in range(wide):
            chances[k] *= below[nodes[k] + (k + 1)]
        if self.length.max() > _SHORT:  # in long words weights would vanish: the same in logs
            self._long_words(vocabulary, np.flatnonzero(long_ & (points != 32)), left, nodes, pieces, chances)
        total = np.zeros(n)
        many = np.zeros(n, np.int64)
        for k in range(wide):
            total[nodes[k]] += chances[k]
            many[nodes[k]] += 1
        self.begin = offsets(many)
        edges = int(self.begin[-1])
        self.size, self.piece = np.empty(edges, np.int8), np.empty(edges, np.int32)
        self.chance, self.upto = np.empty(edges), np.empty(edges, np.float32)
        total = np.maximum(total, 1e-300)
        so_far, place = np.zeros(n, np.float32), self.begin[:-1].copy()
        for k in range(wide):
            at = nodes[k]
            to = place[at]
            place[at] += 1
            chance = chances[k] / total[at]
            so_far[at] += chance.astype(np.float32)
            self.size[to], self.piece[to], self.chance[to], self.upto[to] = k, pieces[k], chance, so_far[at]
        self.upto[self.begin[1:][many > 0] - 1] = 2.0  # the last takes what rounding leaves

    def _long_words(self, vocabulary: Vocabulary, own: np.ndarray, left: np.ndarray, nodes: list[np.ndarray], pieces: list[np.ndarray], chances: list[np.ndarray]) -> None:
        """Put the chances of edges of long words, computed in logs, in their places."""
        row = np.full(len(left), -1, np.int64)
        row[own] = np.arange(len(own))
        weight = np.full((len(own), self.wide), -np.inf)
        mine = [np.flatnonzero(row[x] >= 0) for x in nodes]
        for k, at in enumerate(mine):
            x = pieces[k][at]
            weight[row[nodes[k][at]], k] = np.where(x >= 0, vocabulary.score[x], _FALLBACK)
        reach, logs = np.arange(1, self.wide + 1), np.zeros(len(left) + self.wide)
        order = own[np.argsort(left[own], kind="stable")]
        cuts = np.searchsorted(left[order], np.arange(left[order[-1]] + 2))
        for d in range(1, len(cuts) - 1):
            at = order[cuts[d] : cuts[d + 1]]
            w = min(d, self.wide)
            total = weight[row[at], :w] + logs[at[:, None] + reach[:w]]
            top = total.max(axis=1)
            logs[at] = top + np.log(np.cumsum(np.exp(total - top[:, None]), axis=1)[:, -1])
        for k, at in enumerate(mine):
            x = nodes[k][at]
            chances[k][at] = np.exp(weight[row[x], k] + logs[x + (k + 1)] - logs[x])

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that its number in (0, 1) falls on."""
        edge = self.begin[node]
        open_ = np.flatnonzero(self.upto[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.upto[edge[open_]] <= u[open_]]
        return edge

    def rows(self, node: np.ndarray) -> np.ndarray:
        """The chances of each node's edges by size, zero where there is none."""
        many = self.begin[node + 1] - self.begin[node]
        row = np.repeat(np.arange(len(node)), many)
        edge = np.arange(len(row)) + np.repeat(self.begin[node] - (np.cumsum(many) - many), many)
        out = np.zeros((len(node), self.wide))
        out[row, self.size[edge]] = self.chance[edge]
        return out

    def edge_of(self, node: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The edge of each node that has the given size."""
        edge = self.begin[node]
        open_ = np.flatnonzero(self.size[edge] != size)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.size[edge[open_]] != size[open_]]
        return edge


def _stream(key: np.ndarray, stream: int) -> np.ndarray:
    return mix(key ^ np.uint64(stream * 0x632BE59BD9B4E019 % (1 << 64)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform(key: np.ndarray, stream: int, a: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but their arguments."""
    return _unit(mix(_stream(key, stream) + a.astype(np.uint64) * np.uint64(_P)))


def _choose(chance: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An edge for each row of unnormalised chances."""
    total = np.cumsum(chance, axis=1)
    pick = (total <= (u * total[:, -1])[:, None]).sum(axis=1)
    last = chance.shape[1] - 1 - (chance[:, ::-1] > 0).argmax(axis=1)
    return np.minimum(pick, last)


class Paths:
    """One path for each text of a batch, as steps in text order."""

    def __init__(self, word: np.ndarray, node: np.ndarray, edge: np.ndarray, log: np.ndarray, bounds: np.ndarray):
        self.word, self.node, self.edge, self.bounds = word, node, edge, bounds
        # Logs are integers (see _FINE), so that sums do not depend on what stands before a text.
        self.log = log
        self.total = offsets(log)
        self.owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))  # the text of each step


def _logs(chance: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(chance, 1e-300)) * _FINE).astype(np.int64)


def _walk(lattices: Lattices, word_node: np.ndarray, word_end: np.ndarray, word: np.ndarray, kind: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """Draw steps from the given nodes to their words' ends: (word, node, edge), in order of
    the words given, then of nodes. `base` holds each word's own hash."""
    found, many = [], np.zeros(len(word), np.int64)
    first = lattices.first[kind]
    live = np.flatnonzero(word_node < word_end)
    at, ends, first, base = word_node[live], word_end[live], first[live], base[live]
    while len(live):
        edge = lattices.choose(at, _unit(mix(base + (at - first).astype(np.uint64) * _Q)))
        found.append((live, at, edge))
        many[live] += 1
        at = at + lattices.size[edge] + 1
        open_ = np.flatnonzero(at < ends)
        live, at, ends, first, base = live[open_], at[open_], ends[open_], first[open_], base[open_]
    total = offsets(many)
    node, edge = np.empty(total[-1], np.int64), np.empty(total[-1], np.int64)
    for k, (live, at, taken) in enumerate(found):  # a word's k-th step stands k after its first
        place = total[live] + k
        node[place], edge[place] = at, taken
    return np.repeat(word, many), node, edge


def sample(vocabulary: Vocabulary, keys: np.ndarray, texts: list[str], samples: int = SAMPLES, seed: int = SEED) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text, up to `samples` distinct segmentations in falling order of their
    perturbed values: (log probability, perturbed value, inclusion score, ids). A text
    with fewer segmentations has all of them. The inclusion score is the probability
    of exceeding the next value, given that value: 1 where there is none."""
    split = [parts_of(t) for t in texts]
    words = flat(split)
    docs = len(texts)
    row_key = mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed))
    empty = [(0.0, float(-np.log(-np.log(_uniform(row_key[i : i + 1], 1, np.zeros(1))[0]))), 1.0, np.zeros(0, np.uint32)) for i in range(docs)]
    if not words:
        return [[e] for e in empty]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    lattices = Lattices(vocabulary, list(number))
    kind = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    word_bounds = offsets(np.fromiter(map(len, split), np.int64, docs))
    doc = np.repeat(np.arange(docs), np.diff(word_bounds))
    place = np.arange(len(words)) - word_bounds[doc]
    start, end = lattices.first[kind], lattices.first[kind] + lattices.length[kind]
    every = np.arange(len(words))
    spread = place.astype(np.uint64) * np.uint64(_P)

    def own_hash(stream: int) -> np.ndarray:
        """A hash for each word of each text, in a stream of its own."""
        return mix(_stream(row_key, stream)[doc] + spread)

    def finished(word: np.ndarray, node: np.ndarray, edge: np.ndarray) -> Paths:
        return Paths(word, node, edge, _logs(lattices.chance[edge]), np.searchsorted(doc[word], np.arange(docs + 1)))

    def values(paths: Paths, above: np.ndarray, born: np.ndarray, banned: np.ndarray, stream: int, alive: np.ndarray) -> np.ndarray:
        """The largest perturbed value in the set that leaves the path at each step, from
        the step at which the path was born (before it the set belongs to its parent)."""
        owner = paths.owner
        before = (paths.total[:-1] - paths.total[paths.bounds[:-1]][owner]) / _FINE
        away = 1 - lattices.chance[paths.edge]
        own = np.flatnonzero(born >= 0)
        at = paths.bounds[:-1][own] + born[own]
        c = lattices.rows(paths.node[at])
        c[np.arange(len(c)), lattices.size[paths.edge[at]]] = 0
        away[at] = np.cumsum(c * ((banned[own, None] >> np.arange(c.shape[1]) & 1) == 0), axis=1)[:, -1]
        step = np.arange(len(paths.log)) - paths.bounds[:-1][owner]
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            mass = before + np.log(away)
            u = _unit(mix(_stream(row_key, stream)[owner] + step.astype(np.uint64) * np.uint64(_P)))
            g = mass - np.log(np.exp(mass - above[owner]) - np.log(u))
        g[(away <= 0) | (step < np.where(alive, born, np.iinfo(np.int64).max)[owner])] = -np.inf
        return g

    first = finished(*_walk(lattices, start, end, every, kind, own_hash(2)))
    best = -np.log(-np.log(_uniform(row_key, 1, np.zeros(docs))))
    born, banned = np.full(docs, -1), np.zeros(docs, np.int64)
    alive = np.ones(docs, bool)
    emitted = [(first, best, alive.copy())]
    queues = [(first, values(first, best, born, banned, 3, alive), born, banned)]
    threshold = np.full(docs, -np.inf)
    for r in range(1, samples + 1):
        top, source, step = np.full(docs, -np.inf), np.full(docs, -1), np.zeros(docs, np.int64)
        for q, (paths, g, _, _) in enumerate(queues):
            some = np.flatnonzero(np.diff(paths.bounds) > 0)
            if len(some):
                high = np.maximum.reduceat(g, paths.bounds[:-1][some])
                better = some[high > top[some]]
                top[better] = high[high > top[some]]
                source[better] = q
        for q, (paths, g, _, _) in enumerate(queues):
            own = source == q
            hit = np.flatnonzero((g == top[paths.owner]) & own[paths.owner])
            step[paths.owner[hit[::-1]]] = hit[::-1]
        alive = np.isfinite(top)
        if r == samples:
            threshold = np.where(alive, top, -np.inf)
            break
        if not alive.any():
            break
        # Draw the new path of each text: its parent's steps, another edge, then fresh steps.
        born, banned = np.full(docs, -1), np.zeros(docs, np.int64)
        turned, after = np.full(docs, -1), np.full(docs, np.iinfo(np.int64).max)  # edge, and word, of the turn
        at_node = np.zeros(docs, np.int64)
        for q, (paths, g, was_born, was_banned) in enumerate(queues):
            own = np.flatnonzero((source == q) & alive)
            if not len(own):
                continue
            at = step[own]
            born[own] = at - paths.bounds[own]
            same = born[own] == was_born[own]
            banned[own] = np.where(same, was_banned[own], 0) | (1 << lattices.size[paths.edge[at]].astype(np.int64))
            g[at] = -np.inf
            c = lattices.rows(paths.node[at]) * ((banned[own, None] >> np.arange(lattices.wide) & 1) == 0)
            size = _choose(c, _uniform(row_key[own], 10 * r + 4, born[own]))
            turned[own], after[own], at_node[own] = lattices.edge_of(paths.node[at], size), paths.word[at], paths.node[at]
        # The rest of the word of the turn, and all later words of its text.
        go = np.flatnonzero(every >= after[doc])
        begin = start[go]
        turns = np.flatnonzero(go == after[doc[go]])
        begin[turns] = (at_node + lattices.size[turned] + 1)[doc[go[turns]]]
        w, n, e = _walk(lattices, begin, end[go], go, kind[go], own_hash(10 * r + 5)[go])
        fresh = np.bincount(doc[w], minlength=docs)
        bounds = offsets(np.where(alive, born + 1 + fresh, 0))
        word, node, edge, log = (np.empty(bounds[-1], np.int64) for _ in range(4))
        for q, (paths, _, _, _) in enumerate(queues):
            owner = paths.owner
            local = np.arange(len(owner)) - paths.bounds[:-1][owner]
            kept = np.flatnonzero(local < np.where((source == q) & alive, born, 0)[owner])
            to = bounds[:-1][owner[kept]] + local[kept]
            word[to], node[to], edge[to], log[to] = paths.word[kept], paths.node[kept], paths.edge[kept], paths.log[kept]
        own = np.flatnonzero(alive)
        to = bounds[own] + born[own]
        word[to], node[to], edge[to], log[to] = after[own], at_node[own], turned[own], _logs(lattices.chance[turned[own]])
        to = np.arange(len(w)) - (offsets(fresh)[:-1] - bounds[:-1] - born - 1)[doc[w]]
        word[to], node[to], edge[to], log[to] = w, n, e, _logs(lattices.chance[e])
        path = Paths(word, node, edge, log, bounds)
        emitted.append((path, np.where(alive, top, -np.inf), alive.copy()))
        queues.append((path, values(path, top, born, banned, 10 * r + 6, alive), born, banned))

    out: list[list] = [[] for _ in range(docs)]
    for paths, value, there in emitted:
        logp = (paths.total[paths.bounds[1:]] - paths.total[paths.bounds[:-1]]) / _FINE
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(logp - threshold))
        ids = lattices.piece[paths.edge]
        bare = np.flatnonzero(ids < 0)
        for i in np.flatnonzero(there):
            low, high = paths.bounds[i], paths.bounds[i + 1]
            own = ids[low:high]
            lacking = bare[np.searchsorted(bare, low) : np.searchsorted(bare, high)]
            if len(lacking):  # characters without a piece become their bytes
                built, at = [], low
                for b in lacking:
                    code = [vocabulary.byte_id[x] for x in chr(lattices.points[paths.node[b]]).encode("utf-8", "surrogatepass")]
                    built += [ids[at:b], np.array(code, np.int32)]
                    at = b + 1
                own = np.concatenate([*built, ids[at:high]])
            out[i].append((float(logp[i]), float(value[i]), float(inclusion[i]), own.astype(np.uint32)))
    return [o if len(split[i]) else [empty[i]] for i, o in enumerate(out)]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of a segmentation: pieces joined, bytes decoded, marks turned to spaces,
    the mark that every text begins with taken off."""
    text = b"".join(map(vocabulary.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def segment(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Rows (key, sample from 1, ids, log_probability, perturbed, inclusion, round_trip):
    up to `samples` distinct segmentations of each row's text.

    Null text counts as empty, which has one segmentation, the empty one. Repeated keys
    with the same text get the same samples; a null key has numbers of its own. A mark
    (U+2581) inside a text counts as a space, as in the library. A text is sampled whole, at
    about 110 bytes of memory a character: one of some 25 million characters, or a word of
    more than a million, asks for more time or memory than a small task has. Other columns
    are not read; an empty table gives no rows."""
    ship(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)

    def drawn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        for part in parts:
            keys = part.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            first = 0
            for raw in batches(slices(part.column(1), 1024), 2 << 20):
                texts = [t.decode("utf-8", "replace") for t in raw]
                found = sample(v, keys[first : first + len(texts)], texts, samples, seed)
                rows = [(i, r + 1, *one) for i, some in enumerate(found) for r, one in enumerate(some)]
                at, rank, logp, value, inclusion, ids = zip(*rows)
                same = [decode(v, x) == texts[i].replace(MARK, " ") for i, x in zip(at, ids)]
                values = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets(np.array([len(x) for x in ids])).astype(np.int32)), values)
                yield pa.record_batch(
                    [part.column(0).slice(first, len(texts)).take(pa.array(at)), pa.array(rank, pa.int32()), lists, pa.array(logp), pa.array(value), pa.array(inclusion), pa.array(same)],
                    names=["key", "sample", "ids", "log_probability", "perturbed", "inclusion", "round_trip"],
                )
                first += len(texts)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    kinds = "key long, sample int, ids array<int>, log_probability double, perturbed double, inclusion double, round_trip boolean"
    return rows.mapInArrow(drawn, kinds)
