"""Token ids in binary files: shards compressed by a Re-Pair grammar, read back at random positions.

A shard holds the ids of whole documents, one after another. Re-Pair replaces frequent pairs of
neighbouring symbols by nonterminals until no pair pays for a rule; the shard keeps the rules, what each expands
to in length, the remaining sequence, and the position of every 1024th symbol, so that any range of
ids is decoded without the rest. Shards are cells of a Parquet table, which Spark commits atomically.

Nulls: null text is an empty document (its end id alone); a null doc_id sorts first. Equal ids stay
separate documents, ordered by a hash of their texts. An empty table gives no shard.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, tables

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIIIQ")
STEP = 1024
#: The characters by which byte-level models show bytes that Latin-1 doesn't print.
SHOWN = np.arange(256, dtype="<u2")
SHOWN[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = 256 + np.arange(68)
#: Second bytes of ß-ö and ø-ÿ, whose first is 0xC3.
SECOND = np.zeros(256, dtype=bool)
SECOND[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SHARDS = "part int, shard int, first_doc long, docs long, before long, n_ids long, payload binary"


def compress(ids: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, left, right, expansion length). A rule takes three words and each of its uses saves
    one, so pairs that occur ``least`` times or more without overlap pay. In a round each occurrence
    whose pair is more frequent than the pairs it overlaps with is replaced (every other one of a run
    of equal symbols), as long as ``least`` of its pair are; rounds go on until no pair pays. Only
    places whose pair may still become frequent are looked at again."""
    n, base = len(ids), int(ids.max(initial=0)) + 1
    seq, size = np.append(ids.astype(np.int32), np.int32(-1)), np.ones(n + 1, np.int32)
    # Symbols keep their places, so that a round costs what it looks at; the place after the last ends both chains.
    after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
    before[0] = n
    rank, gone, marked = np.full(n + 1, -1, np.int32), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    lefts, rights, lengths = [], [], []
    rules, at = 0, np.arange(n)
    while True:
        at = at[after[at] < n]
        if len(at) < least:
            break
        right = after[at]
        a, b = seq[at], seq[right]
        # Of a run of equal pairs (a a a) every other one can be replaced.
        same = np.append(False, (a[1:] == b[1:]) & (a[:-1] == a[1:]) & (right[:-1] == at[1:]))
        odd = np.flatnonzero(same)
        run = np.maximum.accumulate(np.where(np.diff(odd, prepend=-2) > 1, odd, 0))
        odd = odd[(odd - run) % 2 == 0]
        even = at
        if len(odd):
            keep = np.ones(len(at), bool)
            keep[odd] = False
            even, a, b = at[keep], a[keep], b[keep]
        order, first = grouped(a.astype(np.int64) << np.int64(26) | b)
        count = np.diff(np.append(first, len(order)))
        paying = np.flatnonzero(count >= least)
        if not len(paying):
            break
        rank_of = np.full(len(first), -1, np.int32)  # by frequency, then by key
        rank_of[paying[np.argsort(count[paying], kind="stable")]] = np.arange(len(paying))
        rank[even[order]] = np.repeat(rank_of, count)
        mine = rank[even]
        paid = np.flatnonzero(mine >= 0)
        spots, mine = even[paid], mine[paid]
        chosen = (mine > rank[before[spots]]) & (mine > rank[after[spots]])
        mine, took = mine[chosen], spots[chosen]
        used = np.bincount(mine, minlength=len(paying))
        enough = used[mine] >= least
        mine, took = mine[enough], took[enough]
        new = (np.cumsum(used >= least) - 1)[mine]
        one = np.zeros(int((used >= least).sum()), np.int64)
        one[new] = took  # any occurrence shows what the rule says
        lefts.append(seq[one]), rights.append(seq[after[one]]), lengths.append(size[one] + size[after[one]])
        runs = at[odd[rank[at[odd - 1]] >= 0]] if len(odd) else odd
        rank[at] = -1
        out = after[took]
        seq[took] = base + rules + new
        size[took] += size[out]
        rules += len(one)
        gone[out] = True
        after[took] = after[out]
        before[after[took]] = took
        before[n] = n
        for places in (spots, runs, took, before[took]):
            marked[places] = True
        marked[out], marked[n] = False, False
        at = np.flatnonzero(marked)
        marked[at] = False
    seq = seq[:n][~gone[:n]]
    join = lambda parts: np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
    return seq.astype(np.uint32), join(lefts), join(rights), join(lengths)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group) of equal keys below 2**52, in one sort of key and place together
    where they fit a word."""
    bits = max(1, int(len(key)).bit_length())
    if len(key) and int(key.max()).bit_length() + bits <= 63:
        packed = np.sort(key << np.int64(bits) | np.arange(len(key)))
        order, sorted_key = packed & np.int64((1 << bits) - 1), packed >> np.int64(bits)
    else:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
    return order, np.flatnonzero(np.diff(sorted_key, prepend=-1))


def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_sizes: np.ndarray, **options: int) -> bytes:
    base = int(ids.max(initial=0)) + 1
    seq, left, right, length = compress(ids, **options)
    size = np.ones(len(seq), dtype=np.int64)
    if len(left):
        size = np.where(seq < base, 1, length[np.maximum(seq.astype(np.int64) - base, 0)]).astype(np.int64)
    marks = (np.cumsum(size) - size)[::STEP].astype("<u8")
    return b"".join((
        HEAD.pack(MAGIC, base, len(left), len(seq), len(doc_ids), len(marks), len(ids)),
        *(x.astype("<u4").tobytes() for x in (left, right, length, seq)),
        doc_ids.astype("<i8").tobytes(), np.cumsum(doc_sizes).astype("<u8").tobytes(), marks.tobytes(),
    ))


class Shard:
    """A shard's parts, viewed in place."""

    def __init__(self, payload: bytes) -> None:
        magic, self.base, rules, seq, docs, marks, self.n_ids = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.left, self.right, self.length = part("<u4", rules), part("<u4", rules), part("<u4", rules)
        self.seq, self.doc_ids, self.doc_ends, self.marks = part("<u4", seq), part("<i8", docs), part("<u8", docs), part("<u8", marks)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """All symbols at once from the place where each begins; a nonterminal leaves its two parts."""
        size = self.sizes(seq)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.uint32)
        while len(seq):
            inner = seq >= self.base
            out[at[~inner]] = seq[~inner]
            rule, at = seq[inner].astype(np.int64) - self.base, at[inner]
            left = self.left[rule]
            seq, at = np.concatenate((left, self.right[rule])), np.concatenate((at, at + self.sizes(left)))
        return out

    def sizes(self, seq: np.ndarray) -> np.ndarray:
        """How many ids each symbol expands to."""
        out = np.ones(len(seq), np.int64)
        inner = np.flatnonzero(seq >= self.base)
        out[inner] = self.length[seq[inner].astype(np.int64) - self.base]
        return out

    def ids(self) -> np.ndarray:
        return self.expand(self.seq)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` .. ``start + n - 1``: only the symbols that cover them are expanded."""
        n = min(n, self.n_ids - start)
        if n <= 0:
            return np.zeros(0, dtype=np.uint32)
        block = int(np.searchsorted(self.marks, start, "right")) - 1
        last = int(np.searchsorted(self.marks, start + n, "left"))
        seq = self.seq[block * STEP : last * STEP]
        size = self.sizes(seq)
        ends = int(self.marks[block]) + np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + n, "left")) + 1
        skipped = start - int(ends[a] - size[a])
        return self.expand(seq[a:b])[skipped : skipped + n]


_CACHE: dict[str, arrays.SegmentCache] = {}


def units(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, whole) of what is encoded by itself: words, cut where an ASCII letter is
    followed by another ASCII character that is none, over which no match of the tokenizer's pattern
    goes; A-Z in lower case, but for letters that a mark might be put to. Words that may hold a
    special token, or the character that parts words, stay as they are (``whole``)."""
    starts, ends = arrays.word_bounds(data, size)
    odd = np.flatnonzero((data[:size] == 60) & (data[1 : size + 1] == 124) | (data[:size] == 1))
    held = np.unique(np.searchsorted(starts, odd, "right") - 1)
    letter = LETTER[data[: size + 1]]
    cut = letter[:-1] & ~letter[1:] & (data[1 : size + 1] > 32) & (data[1 : size + 1] < 127)
    upper = (data[:size] >= 65) & (data[:size] <= 90) & (data[1 : size + 1] < 128)
    inside = arrays.spread(starts[held], (ends - starts)[held])
    cut[inside], upper[inside] = False, False
    low = data.copy()
    low[:size][upper] += 32
    at = np.flatnonzero(cut) + 1
    whole = np.zeros(len(starts) + len(at), bool)
    first = starts[held]
    starts, ends = np.sort(np.concatenate((starts, at))), np.sort(np.concatenate((ends, at)))
    whole[np.searchsorted(starts, first)] = True
    return low, starts, ends, whole


def plain_letters(data: np.ndarray, size: int) -> np.ndarray:
    """How many bytes before each place belong to anything but lower-case letters of Latin-1."""
    here = data[:size]
    first = (here == 0xC3) & SECOND[data[1 : size + 1]]
    good = (here >= 97) & (here <= 122) | first
    good[1:] |= first[:-1]
    return np.concatenate(([0], np.cumsum(~good)))


def word_encoder(path: str) -> Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Encodes with the tokenizers library, each distinct word between ASCII white space once: this
    tokenizer drops white space and merges nothing across it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, cache = Tokenizer.from_file(path), _CACHE.setdefault(path, arrays.SegmentCache(1_200_000))
    # Words go to the library many at a time, with a control character between them to part their ids.
    mark = "\x01"
    tokenize = tokenizer.model.tokenize
    (mark_id,) = tokenizer.encode(mark, add_special_tokens=False).ids

    def encode(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for row, data, offsets in arrays.chunks(column, 2_000_000):
            data, starts, ends, whole = units(data, int(offsets[-1]))
            raw, shown, strange = data.tobytes(), SHOWN[data].tobytes().decode("utf-16-le"), plain_letters(data, int(offsets[-1]))

            def new(first: np.ndarray, starts=starts, ends=ends, whole=whole, raw=raw, shown=shown, strange=strange) -> tuple[np.ndarray, np.ndarray]:
                flat, size = [], np.zeros(len(first), np.int64)
                begin, end = starts[first], ends[first]
                plain = strange[begin] == strange[end]
                alone = whole[first] & ~plain
                words = {i: raw[begin[i] : end[i]].decode() for i in np.flatnonzero(~plain).tolist()}
                many, few, direct = np.flatnonzero(~alone & ~plain), np.flatnonzero(alone), np.flatnonzero(plain)
                for k in range(0, len(many), 512):
                    some = many[k : k + 512]
                    ids = np.array(tokenizer.encode_batch_fast([f" {mark} ".join([words[i] for i in some.tolist()])], add_special_tokens=False)[0].ids, dtype=np.int32)
                    cuts = np.flatnonzero(ids == mark_id)
                    flat.append(ids[ids != mark_id])
                    size[some] = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
                each = [np.array(e.ids, dtype=np.int32) for e in tokenizer.encode_batch_fast([words[i] for i in few.tolist()], add_special_tokens=False)] if len(few) else []
                size[few] = [len(x) for x in each]
                # Lower-case letters alone are one piece as they are, which goes to the model at once.
                pieces = [[t.id for t in tokenize(shown[a:b])] for a, b in zip(begin[direct].tolist(), end[direct].tolist(), strict=True)]
                size[direct] = [len(x) for x in pieces]
                done = np.concatenate([*flat, *each, np.array([i for x in pieces for i in x], np.int32)])
                order = np.concatenate((many, few, direct))
                at = np.empty(len(order), np.int64)
                at[order] = np.cumsum(size[order]) - size[order]
                return done[arrays.spread(at, size)], size

            at, size, flat = cache.rows(arrays.hash_segments(data, starts, ends), new) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
            ids = flat[arrays.spread(at, size.astype(np.int64))]
            upto = np.concatenate(([0], np.cumsum(size)))
            bounds = upto[np.searchsorted(starts, offsets)]
            yield row, ids, np.diff(bounds)

    return encode


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write shards in ascending doc_id
    order; the written table, columns ``SHARDS``. ``before`` counts the ids earlier in the same part."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = before = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, before, number
            flat, key, size = np.concatenate(ids), np.concatenate(keys), np.concatenate(sizes)
            row = {"part": [part], "shard": [number], "first_doc": [int(key[0])], "docs": [len(key)], "before": [before], "n_ids": [len(flat)], "payload": [pack(flat, key, size)]}
            before, number, held = before + len(flat), number + 1, 0
            ids.clear(), keys.clear(), sizes.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("docs", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            key = np.asarray(batch.column(0).fill_null(-(2**63)))
            for row, flat, size in encode(batch.column(1)):
                out = np.full(len(flat) + len(size), end_id, dtype=np.int32)
                out[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
                ids.append(out)
                keys.append(key[row : row + len(size)])
                sizes.append(size + 1)
                held += len(out)
                if held >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return tables.written(ordered.mapInArrow(shards, SHARDS), "token-shards")


def read_ids(shards: DataFrame, start: int, n: int) -> DataFrame:
    """at, ids: the ids ``start`` .. ``start + n - 1`` of the whole corpus, in pieces by shard, from the
    shards that hold them alone."""
    begins = _part_starts(shards)
    placed = shards.join(F.broadcast(begins), "part").withColumn("at", F.col("part_start") + F.col("before"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = max(start - at, 0)
                ids = Shard(payload.as_buffer().to_pybytes()).read(first, start + n - at - first)
                yield pa.RecordBatch.from_pydict({"at": [at + first], "ids": [ids.astype(np.int32)]}, schema=pa.schema([("at", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return placed.where((F.col("at") < start + n) & (F.col("at") + F.col("n_ids") > start)).select("at", "payload").mapInArrow(take, "at long, ids array<int>")


def _part_starts(shards: DataFrame) -> DataFrame:
    """part, part_start: how many ids come before each part, of which there are as many as the writing
    job had tasks."""
    upto, rows = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        rows.append((part, upto))
        upto += n
    return shards.sparkSession.createDataFrame(rows, "part int, part_start long")


def documents_of(shards: DataFrame) -> DataFrame:
    """Read written shards: doc_id, start, n_tokens, ids_crc32 per document."""
    starts = _part_starts(shards)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                raw, ends = memoryview(shard.ids().astype("<u4").tobytes()), shard.doc_ends.astype(np.int64)
                begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                key = pa.array(shard.doc_ids, mask=shard.doc_ids == -(2**63))
                yield pa.RecordBatch.from_arrays([key, pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token shards and read them back."""
    return documents_of(write_shards(tables.texts(docs), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id))
