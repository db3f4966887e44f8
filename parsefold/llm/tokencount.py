"""Token counts of a byte-pair model with scores, without making identifiers.

A text is a linked list of symbols (characters at first) and a heap of adjacent pairs
that the vocabulary has. The pair of lowest rank is popped, its two symbols become one
and the new neighbours enter the heap. The count is the number of initial symbols (a
character the vocabulary lacks counts as its bytes) less the number of merges.

No piece of the vocabulary has a space mark after another character, nor a line feed,
so a text is cut before each space mark and at each line feed, and every distinct part
is counted once.
"""

from __future__ import annotations

import heapq
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.llm.common import ship

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Distinct words of at most SHORT characters that a worker remembers; beyond that it
#: starts anew.
REMEMBERED, SHORT = 1_000_000, 64


class PairMerger(dict):
    """word -> its count. A word that does not begin with a line feed stands for itself
    after a space mark."""

    def __init__(self, model_path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        skip = set(special)
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(size) if i not in skip}
        ordered = sorted(set(scores.values()), reverse=True)
        place = {s: r for r, s in enumerate(ordered)}
        self.rank = {p: place[s] for p, s in scores.items()}
        self.bytes = any(model.is_byte(i) for i in range(size))
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("the vocabulary has pieces across words; whole texts can't be cut")
        self.parts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def merges(self, symbols: list[str]) -> list[str]:
        """Merge in place to the end; merged-away symbols are left empty."""
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(symbols[i] + symbols[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + symbols[i])
                if r is not None:
                    heapq.heappush(heap, (r, h, size + len(symbols[h])))
        return symbols

    def count_part(self, part: str) -> int:
        rank = self.rank
        cost = sum(1 if c in rank or not self.bytes else len(c.encode()) for c in part)
        left = sum(1 for s in self.merges(list(part)) if s)
        return cost - (len(part) - left)

    def __missing__(self, word: str) -> int:
        n = self.count_part(word if word[:1] == "\n" else MARK + word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] == " " or "  " in text or MARK in text:
            whole = MARK + text.replace(" ", MARK)
            return sum(self[p] if p[:1] == "\n" else self[p[1:]] if p[0] == MARK and p[1:2] not in ("", MARK) else self._bare(p) for p in self.parts.findall(whole))
        return sum(map(self.__getitem__, text.replace("\n", " \n").split(" ")))

    def _bare(self, part: str) -> int:
        """A run of marks, or a part without a mark before it."""
        key = "\n" + part  # a line feed merges with nothing and counts by itself
        return self[key] - self["\n"]


_LOADED: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    if path not in _LOADED:
        _LOADED[path] = PairMerger(path)
    return _LOADED[path]


def with_token_counts(df: DataFrame, text: str = "text", model_path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text in column `out` (long), which is
    replaced if it is there. Null text and empty text have none; a very long text is counted
    whole, word by word; repeated rows are counted
    one by one; an empty table gives no rows; other columns are kept as they are."""
    ship(df.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)

    def counted(texts: pa.Array) -> pa.Array:
        count = merger(path).count
        return pa.array([count(t.as_py() or "") for t in texts], pa.int64())

    return df.withColumn(out, F.arrow_udf(counted, T.LongType())(F.col(text).cast("string")))
