"""Operator 5: SentencePiece encoding with offsets, and decoding.

The normaliser is rebuilt from the model: at each byte the longest prefix found
in the compiled character map (a double-array trie) is replaced, any other
character passes, and every normalised byte remembers where its source began.
The library segments; piece lengths then tile the normalised bytes, so each
piece projects to a span of original bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded

SPACE_MARK = "▁".encode()
_loaded: dict[str, Codec] = {}


class CharMap:
    """The compiled map: a 32-bit size, that many bytes of trie units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest entry that begins at ``at``.

        A unit holds in bits 0-7 and 31 its label, in bit 8 whether a value hangs on
        it, and in bits 10-30 (shifted by eight more with bit 9) the offset to its children.
        """
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != data[k]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value = self.units[node] & ((1 << 31) - 1)
                found = k + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Codec:
    """One model: normaliser, segmenter and decoder."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.size = np.array([0 if p.type == kinds.CONTROL else 1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and for the end) the original byte where its source begins."""
        if not self.map.units and not self.squeeze:
            return self._identity(data)
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = n, data[at : at + n]
            parts.append((hit[1], at, at + hit[0]))
            at += hit[0]
        if self.squeeze:  # leading blanks go, with what they consumed
            while parts and parts[0][0].strip(b" ") == b"" and parts[0][0] != b"":
                parts.pop(0)
        out, source, blank, mark = bytearray(), [], self.squeeze, SPACE_MARK if self.escape else b" "
        if self.dummy and parts:
            out += mark
            source += [parts[0][1]] * len(mark)
        end = parts[0][1] if parts else len(data)
        for text, start, stop in parts:
            if blank and self.squeeze:
                text = text.lstrip(b" ")
            for byte in text:
                new = mark if byte == 0x20 else bytes([byte])
                out += new
                source += [start] * len(new)
            if text:
                blank = text.endswith(b" ")
                if not (self.squeeze and blank):
                    end = stop
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], source[-len(mark) :]
                end = source[-1] if not source else end
        return bytes(out), np.array([*source, end], np.int64)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same without a character map, in whole-array steps."""
        if not data:
            return b"", np.zeros(1, np.int64)
        mark = SPACE_MARK if self.escape else b" "
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 0x20, len(mark), 1)
        source = np.repeat(np.arange(len(raw)), width)
        text = data.replace(b" ", mark)
        if self.dummy:
            text, source = mark + text, np.concatenate([np.zeros(len(mark), np.int64), source])
        return text, np.append(source, len(data))

    def spans(self, ids: list[int], normal: bytes, source: np.ndarray) -> np.ndarray:
        """Original byte range ``[start, end)`` of each piece: its length tiles the normalised bytes."""
        size = self.size[ids]
        if (size < 0).any():  # a piece outside the vocabulary has the length that is left to it
            pieces = self.library.encode(normal.decode(), out_type=str)
            inner = [len(p.encode()) for p in pieces]
            size[size != 0] = inner[: np.count_nonzero(size)]
        ends = np.cumsum(size)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces do not tile the normalised text")
        return np.stack([source[ends - size], source[ends]], 1)

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[list[int]]:
        return self.library.encode(texts, add_bos=bos, add_eos=eos, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def codec(path: str) -> Codec:
    """The model, once per worker process."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _groups(texts: list[str], limit: int = 1 << 19):
    """Index ranges of about ``limit`` characters."""
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_pieces(docs: DataFrame, model: str, output: str = "spans") -> DataFrame:
    """Encode every whole text with begin and end ids, and decode the ids again.

    Returns ``doc_id, ids, starts, ends, decoded``: ids as the library gives them,
    for each id the original UTF-8 byte span it stands for (empty for begin and
    end), and the library's decoding.  With ``output="digests"`` the arrays stay in
    the task and ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered`` return,
    where ``n_covered`` counts original bytes under the spans; ``output="ids"`` returns
    these and ``ids``.  A null text is an empty one; null ids and repeated rows stay;
    other columns are ignored.
    """
    if output not in ("spans", "digests", "ids"):
        raise ValueError(f"no such output: {output}")

    def run(batches):
        c = codec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in _groups(texts):
                part = texts[low:high]
                ids = c.encode(part)
                decoded = c.decode(ids)
                spans = []
                for text, own in zip(part, ids, strict=True):
                    normal, source = c.normalise(text.encode())
                    spans.append(c.spans(own, normal, source))
                rows = batch.column(0).slice(low, high - low)
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"]
                if output != "spans":
                    columns = [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                        pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                    ]
                    if output == "ids":
                        names, columns = [*names, "ids"], [*columns, pa.array(ids, pa.list_(pa.int32()))]
                    yield pa.record_batch([rows, *columns], names)
                else:
                    longs = pa.list_(pa.int64())
                    yield pa.record_batch([rows, pa.array(ids, pa.list_(pa.int32())), pa.array([s[:, 0] for s in spans], longs), pa.array([s[:, 1] for s in spans], longs), pa.array(decoded, pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long" + ", ids array<int>" * (output == "ids")
    if output == "spans":
        schema = "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string"
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
