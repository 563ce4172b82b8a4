"""Operator 11: byte-level BPE encoding and decoding, as a reduction over a tree of halves.

Encodings of neighbouring byte strings join associatively, so a piece is encoded by
halves: both are encoded, and their tokens are joined by encoding anew the bytes of a
window around the boundary, which grows until the tokens outside it provably stand.

Proof of the stopping rule.  Call two tokens *compatible* when merging their joint bytes
gives back just these two.  A sequence of tokens is the encoding of its bytes exactly
when all neighbours are compatible.  For in a run of the merges restrict the steps to
two neighbours: each step takes the lowest rank, leftmost first, over all places, hence
also over these two tokens and their boundary, so until a merge crosses the boundary
the steps are those of the two alone; the first merge that crosses any boundary would
therefore occur for the two alone as well, and the other way round.  The tokens outside
the window are compatible already, those within it come from one encoding; so once the
pairs at its two edges are compatible, all are.

Decoding concatenates the tokens' bytes up a tree of halves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded
from .token_counts import pieces

#: Bytes merged directly at the leaves of the tree.
LEAF = 8
#: Remembered pieces and windows (short ones only) of a worker: their number is bounded, the answers do not depend on it.
MOST_PIECES, PIECE_BYTES, MOST_WINDOWS, WINDOW_BYTES = 1 << 19, 48, 1 << 18, 16
#: Ids concatenated directly at the leaves when decoding.
LEAF_IDS = 4096
#: Texts of one output batch, in characters.
GROUP_CHARS = 1 << 19

_loaded: dict[tuple[str, str], ByteBpe] = {}


class ByteBpe:
    """One vocabulary of ranked byte strings with its splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._pieces: dict[str, bytes] = {}
        self._windows: dict[bytes, list[int]] = {}

    @staticmethod
    def read(path: str, pattern: str) -> ByteBpe:
        """A file of lines ``base64 rank``."""
        with open(path, "rb") as lines:
            return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Direct merging: the neighbours of lowest rank, leftmost first, until none has a rank."""
        if len(data) > WINDOW_BYTES:
            return self._merge_long(data)
        found = self._windows.get(data)
        if found is None:
            if len(self._windows) >= MOST_WINDOWS:
                self._windows.clear()
            found = self._windows[data] = self._merge_short(data)
        return found

    def _merge_short(self, data: bytes) -> list[int]:
        rank, none = self.ranks.get, 1 << 62
        at = list(range(len(data) + 1))
        scores = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while scores and (best := min(scores)) < none:
            i = scores.index(best)
            del scores[i], at[i + 1]
            if i < len(scores):
                scores[i] = rank(data[at[i] : at[i + 2]], none)
            if i:
                scores[i - 1] = rank(data[at[i - 1] : at[i + 1]], none)
        return [self.ranks[data[a:b]] for a, b in zip(at, at[1:])]  # noqa: B905

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of the neighbours."""
        n, rank = len(data), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if after[i] != middle or middle == n or after[middle] != end:  # one of the two has changed since
                continue
            after[i], after[middle], before[end] = end, -1, i
            if end < n and (r := rank(data[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, end, after[end]))
            if i and (r := rank(data[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], i, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def compatible(self, a: int, b: int) -> bool:
        return self.merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two strings' concatenation from their encodings."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        i = j = 1  # tokens of either side in the window
        while True:
            window = self.merge(b"".join(map(self.bytes.__getitem__, left[len(left) - i :] + right[:j])))
            grow_left = i < len(left) and not self.compatible(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.compatible(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + window + right[j:]
            i = min(len(left), 2 * i) if grow_left else i
            j = min(len(right), 2 * j) if grow_right else j

    def tokens(self, data: bytes) -> list[int]:
        """Tokens of one byte string, by halves."""
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tokens(data[:half]), self.tokens(data[half:]))

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern as little-endian 32-bit integers; a piece of the vocabulary is one token."""
        found = self._pieces.get(text)
        if found is None:
            data = text.encode()
            own = self.ranks.get(data)
            found = np.array(self.tokens(data) if own is None else [own], "<u4").tobytes()
            if len(data) <= PIECE_BYTES:
                if len(self._pieces) >= MOST_PIECES:
                    self._pieces.clear()
                self._pieces[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, each match of the pattern by itself."""
        known, piece, split = self._pieces, self.piece, self.pattern.findall
        return np.frombuffer(b"".join([known.get(p) or piece(p) for part in pieces(text) for p in split(part)]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self.bytes[i] for i in ids.tolist()])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def vocabulary(path: str, pattern: str) -> ByteBpe:
    """The vocabulary, once per worker process."""
    key = path, pattern
    if key not in _loaded:
        _loaded[key] = ByteBpe.read(path, pattern)
    return _loaded[key]


def _groups(sizes: list[int], limit: int):
    """Index ranges whose sizes sum to about ``limit``."""
    at = total = 0
    for k, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, output: str = "ids") -> DataFrame:
    """Ids of every whole text by the rank file ``ranks``, each match of ``pattern`` by itself, without special tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Returns ``doc_id,
    n_tokens, ids_sha256, decoded_sha256`` (the ids as little-endian 32-bit integers, and the
    bytes that ``decode`` gives for them) and with ``output="ids"`` also ``ids``.  A null text is
    an empty one; null ids and repeated rows are returned as they are; an empty table gives an
    empty result.  A text is handled whole, longer ones cut where the pattern begins anew.
    """
    if output not in ("ids", "digests"):
        raise ValueError(f"no such output: {output}")

    def run(batches):
        bpe = vocabulary(ranks, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in _groups([len(t) for t in texts], GROUP_CHARS):
                ids = [bpe.encode(t) for t in texts[low:high]]
                columns = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if output == "ids":
                    names, columns = [*names, "ids"], [*columns, pa.array([x.view("<i4") for x in ids], pa.list_(pa.int32()))]
                yield pa.record_batch([batch.column(0).slice(low, high - low), *columns], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * (output == "ids")
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, data (binary)`` from rows ``doc_id, ids``; null ids are none. An id outside the vocabulary raises."""

    def run(batches):
        bpe = vocabulary(ranks, pattern)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            for low, high in _groups([len(x) for x in ids], GROUP_CHARS):
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array([bpe.decode(x) for x in ids[low:high]], pa.binary())], ["doc_id", "data"])

    return bounded(encoded).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")
