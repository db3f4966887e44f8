"""Packing of documents into sequences of at most CAPACITY tokens.

Texts are tokenized once; what is kept of each piece is its place, length and a digest
of its ids. Pieces are dealt at random into blocks of bounded size. In a block, best
fit in falling order gives a first packing, and a swap-based local search then takes
the emptiest bin and moves its pieces, or exchanges one for one or one for two, into
other underfull bins, each step increasing the sum of squared fills, until the bin is
empty or no step is left. The bins that stay underfull are opened and dealt again, so
that what blocks leave over is packed together, until one block holds all of it or no
bin less is needed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsefold.llm.common import give_back, mix, ship, table
from parsefold.llm.tokenizing import byte_bpe, forget

CAPACITY = 2048
END = 0
BLOCK = 8192
JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", json_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]) of every document: its ids
    and a final 0. Null text counts as empty: one piece, of the 0 alone."""
    ship(docs.sparkSession)
    names = (json_path or public_tokenizers.path(JSON), ranks_path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    end = np.array([END], np.uint32).tobytes()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = byte_bpe(*names), 0
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for part in parts:
            for low in range(0, part.num_rows, 512):
                some, at, rows = part.slice(low, 512), [], []
                for k, t in enumerate(some.column(1).to_pylist()):
                    ids = bpe.ids(t or "") + end
                    for p, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                        blob = ids[4 * start : 4 * (start + n)]
                        at.append(k)
                        rows.append((p, start, n, zlib.crc32(blob), blob))
                p, start, n, crc, blobs = zip(*rows)
                salt = mix(np.arange(seen, seen + len(rows)).astype(np.uint64) + np.uint64(base)) >> np.uint64(1)
                seen += len(rows)
                columns = [some.column(0).take(pa.array(at)), pa.array(p, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, n, crc)), pa.array(salt.astype(np.int64))]
                out = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                if keep_ids:
                    columns, out = [*columns, pa.array(blobs, pa.binary())], [*out, "ids"]
                yield pa.record_batch(columns, names=out)
            give_back()
        del bpe
        forget()
        give_back()

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + ", ids binary" * keep_ids
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(cut, kinds)


# ---------------------------------------------------------------- one block


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: falling lengths, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        room -= n
        if room:
            by_room[room].append(k)
            rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges between underfull bins, until a round over all
    of them empties none. Each step moves tokens from the bin being emptied to a fuller
    one, so the sum of squared fills grows with every step and the search ends."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    emptied = True
    while emptied:
        open_ = sorted((f, k) for k, f in enumerate(fill) if 0 < f < capacity)
        emptied = False
        for _, k in open_:
            if not 0 < fill[k] < capacity:
                continue
            emptied |= _empty(k, [j for _, j in open_ if j != k], bins, size, fill, capacity)
    return [b for b in bins if b]


def _empty(k: int, others: list[int], bins: list[list[int]], size: list[int], fill: list[int], capacity: int) -> bool:
    """Push the pieces of bin k into fuller bins; True if it ended empty."""
    rooms = sorted((capacity - fill[j], j) for j in others if fill[j] >= fill[k] and 0 < fill[j] < capacity)
    step = True
    while step and bins[k]:
        step = False
        for i in sorted(bins[k], key=lambda i: -size[i]):
            at = bisect_left(rooms, (size[i], -1))
            if at < len(rooms):  # move: the fullest bin that takes it
                _, j = rooms.pop(at)
                bins[k].remove(i)
                bins[j].append(i)
                step = True
            else:
                found = _exchange(i, rooms, bins, size)
                if not found:
                    continue
                at, back = found
                _, j = rooms.pop(at)
                for b in back:
                    bins[j].remove(b)
                bins[j].append(i)
                bins[k].remove(i)
                bins[k] += back
                step = True
            fill[j], fill[k] = sum(size[x] for x in bins[j]), sum(size[x] for x in bins[k])
            if fill[j] < capacity:
                insort(rooms, (capacity - fill[j], j))
            break
    return not bins[k]


def _exchange(i: int, rooms: list[tuple[int, int]], bins: list[list[int]], size: list[int]) -> tuple[int, list[int]] | None:
    """Where piece i can go in exchange for one or for two smaller pieces: the place in
    rooms and the pieces that come back, chosen so that the other bin gains most."""
    best: tuple[int, int, list[int]] | None = None
    for at, (room, j) in enumerate(rooms):
        own = bins[j]
        for x, b in enumerate(own):
            gain = size[i] - size[b]
            if 0 < gain <= room and (best is None or gain > best[0]):
                best = (gain, at, [b])
            for c in own[x + 1 :]:
                gain = size[i] - size[b] - size[c]
                if 0 < gain <= room and (best is None or gain > best[0]):
                    best = (gain, at, [b, c])
        if best and best[0] == rooms[best[1]][0]:
            break  # that bin is now full
    return (best[1], best[2]) if best else None


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and fill of the bin, for each length."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    where, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            where[i], offset[i] = k, at
            at += int(lengths[i])
        fill[b] = at
    return where, offset, fill


# ---------------------------------------------------------------- all blocks


def _packed(rows: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    names = [f.name for f in rows.schema if f.name not in ("block", "sequence_id", "offset", "fill")]

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("salt", "ascending")])
        where, offset, fill = pack_block(group.column("length").to_numpy(), capacity)
        block = group.column("block")[0].as_py()
        sequence = (np.int64(level) << 56) + (np.int64(block) << 20) + where
        out = group.select(names)
        for name, x in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(x))
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    dealt = rows.select(*names, F.pmod(F.xxhash64("salt", F.lit(level)), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(one, kinds + ", sequence_id long, offset long, fill long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", json_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, block: int = BLOCK, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-
    endian 32-bit, if kept). A document of at most `capacity` tokens stays whole. Null
    text counts as empty; repeated rows and null ids are packed like any others, one
    piece set for each row; an empty table gives no rows. Extra columns are not read."""
    kept = table(pieces(docs, doc_id, text, json_path, ranks_path, capacity, keep_ids), "pieces")
    n, level, before, done = kept.count(), 0, None, []
    left = kept
    while True:
        blocks = -(-n // block) or 1
        done.append(_packed(left, blocks, level, capacity))
        if blocks == 1:
            break
        done[-1] = now = table(done[-1], "packed")
        left = now.where(F.col("fill") < capacity)
        n, bins = left.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if before is not None and bins >= before:
            break
        done[-1] = now.where(F.col("fill") == capacity)
        before, level = bins, level + 1
    every = reduce(DataFrame.unionByName, done)
    return every.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
