"""SentencePiece encoding that keeps offsets, and decoding.

Encoding has three steps. (1) Normalisation replaces, at each place, the longest
prefix that the model's compiled character map holds (a double-array trie in
front of a block of replacement strings) and notes for every byte it emits from
which byte of the text it came. (2) The normalised text is cut into units that no
piece of the vocabulary crosses, and the library segments each new unit with its
own normalisation switched off; a worker remembers the units it has met. (3) The
byte lengths of the pieces, summed up, are looked up in the alignment of step 1:
that gives each piece its span of original bytes. A piece that fallback bytes
split covers its one byte, the piece of the added first space covers none.

Inputs: null text counts as empty (no ids, decoded ""); repeated rows are
encoded as often as they occur; an empty table gives no rows; other columns are
ignored. Ids are those of the library's encode() without begin or end ids.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.llm import common

SPACE = "▁"
#: Units kept per worker; about 150 MB when full. Then it starts anew.
KEPT_UNITS = 400_000


class CharacterMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, compiled: bytes):
        n = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.trie = np.frombuffer(compiled, "<u4", n // 4, 4).tolist() if n else []
        self.strings = compiled[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement and the number of bytes it stands for."""
        if not self.trie:
            return None
        unit, found = self.trie[0], None
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.trie[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (self.trie[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]


class Encoder:
    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap)
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with white space as a suffix are not supported")
        self.user = sorted((p.piece.encode() for p in proto.pieces if p.type == 4), key=len, reverse=True)
        self.plain = not (self.map.trie or self.squeeze or self.user) and self.escape
        self.library = SentencePieceProcessor(model_proto=model)
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        spec.precompiled_charsmap = b""
        self.segmenter = SentencePieceProcessor(model_proto=proto.SerializeToString())
        #: Bytes of text under each id: the piece's, or one for a fallback byte; -1 for the unknown id.
        self.widths = np.array([{1: len(p.piece.encode()), 4: len(p.piece.encode()), 5: len(p.piece.encode()), 6: 1, 2: -1}.get(p.type, 0) for p in proto.pieces], dtype=np.int64)
        whole = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type in (1, 4, 5))
        line = not any("\n" in p.piece and len(p.piece) > 1 for p in proto.pieces)
        self.units = re.compile("(?s).+" if whole else rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if line else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.by_word = not whole and self.plain and self.prefix
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes the original byte it stands at; the end is last."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            at = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            head = [0, 0, 0] if self.prefix else []
            return SPACE * self.prefix + text.replace(" ", SPACE), np.concatenate([head, at, [len(raw)]]).astype(np.int64)
        space = SPACE.encode() if self.escape else b" "
        out, origin, k = bytearray(), [], 0

        def replaced(k: int) -> tuple[bytes, int]:
            for symbol in self.user:
                if data.startswith(symbol, k):
                    return symbol, len(symbol)
            if found := self.map.longest(data, k):
                return found
            width = 1 + (data[k] >= 0xC0) + (data[k] >= 0xE0) + (data[k] >= 0xF0)
            return data[k : k + width], width

        if self.squeeze:
            while k < len(data) and replaced(k)[0] in (b" ", b""):
                k += replaced(k)[1]
            if k == len(data):
                return "", np.array([k])
        if self.prefix:
            out += space
            origin += [k] * len(space)
        after_space = self.squeeze
        while k < len(data):
            put, width = replaced(k)
            if after_space:
                put = put.lstrip(b" ")
            if put:
                if self.escape:
                    put_out = put.replace(b" ", space)
                else:
                    put_out = put
                out += put_out
                origin += [k] * len(put_out)
                after_space = self.squeeze and put.endswith(b" ")
            k += width
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], origin[-len(space) :]
        return out.decode(), np.array([*origin, len(data)], np.int64)

    def learn(self, units: list[str]) -> None:
        for k in range(0, len(units), 4096):
            some = units[k : k + 4096]
            for unit, ids in zip(some, self.segmenter.encode(some, num_threads=1), strict=True):
                a = np.array(ids, dtype="<u4")
                wide = self.widths[a]
                if (wide < 0).any():  # the unknown id covers what the others leave
                    wide = self.around_unknown(unit, a)
                self.known[unit] = (a.tobytes(), wide.astype("<u4").tobytes())

    def around_unknown(self, unit: str, ids: np.ndarray) -> np.ndarray:
        pieces = self.segmenter.encode(unit, return_type="proto").pieces
        return np.array([len(p.surface.encode()) for p in pieces], np.int64)

    def need(self, units: list[str]) -> None:
        new = list(set(units).difference(self.known))
        if new:
            self.learn(new)

    def learn_words(self, new: list[str]) -> None:
        """Words follow one space; a word over several lines is several units."""
        cut = [self.units(SPACE + w) for w in new]
        self.need([u for us in cut for u in us])
        for w, us in zip(new, cut, strict=True):
            got = [self.known[u] for u in us]
            self.words[w] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), b"".join([g[1] for g in got]))

    def segment(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids and widths in normalised bytes of each text's pieces."""
        out = []
        for k in range(0, len(texts), 64):
            some = texts[k : k + 64]
            words = [t.split(" ") if self.by_word and t and SPACE not in t and "  " not in t and t[0] != " " and t[-1] != " " else None for t in some]
            if max(len(self.words), len(self.known)) > KEPT_UNITS:  # between batches only: a batch's units must all be there
                self.words.clear()
                self.known.clear()
            new = list(set().union(*[w for w in words if w]).difference(self.words))
            if new:
                self.learn_words(new)
            for t, w in zip(some, words, strict=True):
                if w:
                    got = [self.words[x] for x in w]
                else:
                    units = self.units(self.normalise(t)[0])
                    self.need(units)
                    got = [self.known[u] for u in units]
                out.append((np.frombuffer(b"".join([g[0] for g in got]), "<u4"), np.frombuffer(b"".join([g[1] for g in got]), "<u4")))
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, first byte and end byte of each piece, of each text."""
        for text, (ids, widths) in zip(texts, self.segment(texts), strict=True):
            at = self.normalise(text)[1]
            ends = np.cumsum(widths, dtype=np.int64)
            if len(ids) and ends[-1] != len(at) - 1:
                raise ValueError("the pieces do not add up to the normalised text")
            ends_at = at[ends]
            starts_at = np.concatenate([at[:1], ends_at[:-1]]) if len(ids) else ends_at
            yield ids, starts_at, ends_at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, starts, ends: the pieces and their spans in the UTF-8 bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            found = list(e.encode(batch.column(1).to_pylist()))
            lists = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in range(3)]
            yield pa.record_batch([batch.column(0), *lists], names=["doc_id", "ids", "starts", "ends"])

    return rows(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and decoded, the library's text for the ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(model).library
        for batch in batches:
            texts = [library.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """encode() and decode() of each text in one pass, returned as digests instead of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        decimal = [str(i) for i in range(len(e.widths))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids_sha, decoded_sha, spans = [], [], [], []
            for ids, starts, ends in e.encode(batch.column(1).to_pylist()):
                listed = ids.tolist()
                n.append(len(listed))
                ids_sha.append(sha(",".join([decimal[i] for i in listed]).encode()))
                decoded_sha.append(sha(e.library.decode(listed).encode()))
                spans.append(zlib.crc32(np.stack([starts, ends], axis=1).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(spans, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
