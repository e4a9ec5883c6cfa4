"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges of a byte-pair model come up by score, then from the left, from an agenda of candidate pairs;
a candidate is skipped when the keyed hash of (seed, document, unit's number, position, left, right)
falls below ``dropout``, so every occurrence of a word has a draw of its own. Texts are cut into units
that no piece crosses (a run of blanks and what follows it; line ends and tabs alone). Short units go
through the agenda many at a time, long ones one by one on a heap; both give the same pieces. With
``dropout`` 0 they are those of the library. A worker keeps these, with their merges, for the units it
met: an occurrence whose draw skips none of them has the same pieces and needs no agenda of its own.

Characters that the model lacks, and the sign that it keeps for blanks, are spelled in bytes, so every
text decodes to itself.

Nulls: null text is empty and has no pieces; a null doc_id counts as 0 in the hash. Repeated rows have
equal pieces, copies under other ids different ones. Extra columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from . import arrays, tables

BLANK = "▁"
LONE = np.zeros(256, dtype=bool)
LONE[[0x09, 0x0A, 0x0D]] = True


def mark_of(spots: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of a candidate merge within its unit."""
    pair = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | right.astype(np.int64).astype(np.uint64)
    return arrays.mix(pair + spots.astype(np.int64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class PieceModel:
    """The pieces of a model file as lookup tables."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        usable = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.char = np.full(0x110000, -1, dtype=np.int32)
        scores = np.array([model.get_score(i) for i in range(len(pieces))])
        ranks = np.searchsorted(np.unique(-scores), -scores)
        rows = []
        for p, i in usable.items():
            if len(p) == 1:
                self.char[ord(p)] = i
            rows += [(usable[p[:k]], usable[p[k:]], ranks[i], i) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        self.char[ord(" ")], self.char[ord(BLANK)] = self.char[ord(BLANK)], -1
        self.merges = arrays.Merges(*(np.array(c) for c in zip(*rows, strict=True)))
        spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() if p in usable else b"" for i, p in enumerate(pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled])
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.cache = arrays.SegmentCache(300_000)

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single-character pieces of each unit, bytes where there is none."""
        lengths = ends - starts
        raw = data[arrays.spread(starts, lengths)]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        head = (raw & 0xC0) != 0x80
        chars = np.add.reduceat(head, np.cumsum(lengths) - lengths).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        ids = self.char[points]
        lacking = np.flatnonzero(ids < 0)
        if len(lacking):
            width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
            size = np.where(ids < 0, width, 1)
            out = np.repeat(ids, size)
            out[out < 0] = self.bytes[raw[arrays.spread(np.flatnonzero(head)[lacking], width[lacking])]]
            unit = np.repeat(np.arange(len(chars)), chars)
            return out, np.bincount(unit, size, len(chars)).astype(np.int64)
        return ids, chars

    def encode(self, texts: list[bytes], keys: np.ndarray, dropout: float, seed: int, block: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pieces per text); ``keys`` are the documents' hashes; ``block`` units are
        segmented at a time."""
        data = np.frombuffer(b"".join([*((b" " + x + b"\n") if x else b"\n" for x in texts), b"\0" * 8]), dtype=np.uint8)
        sizes = np.array([len(x) + 1 + (len(x) > 0) for x in texts])
        ends_of = np.cumsum(sizes)
        n = len(data) - 8
        lone, blank = LONE[data[:n]], data[:n] == 0x20
        opens = lone.copy()
        opens[1:] |= lone[:-1] | (blank[1:] & ~blank[:-1])
        opens[0] = True
        opens[ends_of - 1] = True
        opens[ends_of[:-1]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], n)
        owner = np.searchsorted(ends_of, starts, "right")
        real = starts != ends_of[owner] - 1
        starts, ends, owner = starts[real], ends[real], owner[real]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        unit = arrays.hash_segments(data, starts, ends)
        first = np.searchsorted(owner, np.arange(len(texts)))
        number = np.arange(len(owner)) - first[owner]
        draw = arrays.mix(keys[owner] ^ arrays.mix(number.astype(np.uint64) + np.uint64(seed)))
        bar = np.uint64(min(max(dropout, 0.0), 1.0) * float(2**64 - 2049))
        parts = [self.segmented(data, starts[a : a + block], ends[a : a + block], unit[a : a + block], draw[a : a + block], bar) for a in range(0, len(starts), block)]
        return np.concatenate([p[0] for p in parts]), np.bincount(owner, np.concatenate([p[1] for p in parts]), len(texts)).astype(np.int64)

    def segmented(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: np.ndarray, draw: np.ndarray, bar: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pieces per unit). A unit none of whose own merges are skipped by its draw has the pieces
        it would have without dropout, which are kept with these merges; others go through the agenda."""

        def plain(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each unit the number of its pieces, the pieces, and the marks of its merges."""
            rows, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

            def note(row, spots, left, right):
                rows.append(np.asarray(row))
                marks.append(mark_of(spots, left, right))
                return np.zeros(len(spots), dtype=bool)

            ids, n = self.merges.many(*self.symbols(data, starts[new], ends[new]), note)
            row = np.concatenate(rows)
            merges = np.bincount(row, minlength=len(n))
            width = 1 + n + 2 * merges
            at = np.cumsum(width) - width
            out = np.empty(int(width.sum()), dtype=np.int32)
            out[at] = n
            out[arrays.spread(at + 1, n)] = ids
            out[arrays.spread(at + 1 + n, 2 * merges)] = np.concatenate(marks)[np.argsort(row, kind="stable")].view(np.int32)
            return out, width

        at, width, flat = self.cache.rows(unit, plain)
        size = flat[at].astype(np.int64)
        merges = (width - 1 - size) // 2
        of = np.repeat(np.arange(len(unit)), merges)
        hit = arrays.mix(draw[of] ^ flat[arrays.spread(at + 1 + size, 2 * merges)].view(np.uint64)) < bar
        again = np.flatnonzero(np.bincount(of[hit], minlength=len(unit)))
        if not len(again):
            return flat[arrays.spread(at + 1, size)], size
        own = draw[again]
        ids, n = self.merges.many(*self.symbols(data, starts[again], ends[again]), lambda row, spots, left, right: arrays.mix(own[row] ^ mark_of(spots, left, right)) < bar)
        begin = at + 1
        begin[again] = len(flat) + np.cumsum(n) - n
        size[again] = n
        return np.concatenate((flat, ids))[arrays.spread(begin, size)], size

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts of rows of ids; the blank put before a text is taken off again."""
        length = self.spelled_size[ids]
        raw = self.spelled[arrays.spread(self.spelled_at[ids], length)].tobytes()
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(sizes)))]
        return [raw[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@cache
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model: str | None = None, dropout: float = 0.1, seed: int = 17, chunk_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32 (of the ids as little-endian 32-bit integers), lossless
    (whether the ids decode to the text) of each document."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(path)
        for batch in batches:
            keys = arrays.mix(np.asarray(batch.column(0).fill_null(0)).astype(np.int64).view(np.uint64) + np.uint64(seed))
            column = batch.column(1).cast(pa.large_binary())
            upto = np.cumsum(np.asarray(pc.binary_length(column)).astype(np.int64))
            cuts = np.flatnonzero(np.diff(upto // chunk_bytes, prepend=0))
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if b <= a:
                    continue
                texts = column.slice(a, b - a).to_pylist()
                ids, sizes = pieces.encode(texts, keys[a:b], dropout, seed)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                raw = memoryview(ids.astype("<i4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                same = [x == y for x, y in zip(pieces.decode(ids, sizes), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), lists, pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids", "ids_crc32", "lossless"])

    return tables.texts(docs).mapInArrow(tables.lean(work, model_of.cache_clear), "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, lossless boolean")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                lists = batch.column(1).slice(k, 512)
                sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                texts = pieces.decode(np.asarray(lists.flatten()).astype(np.int64), sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 512), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(tables.lean(work, model_of.cache_clear), "doc_id long, text string")
