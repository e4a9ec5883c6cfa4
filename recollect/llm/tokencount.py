"""Token counts by a compiled finite-state tokenizer.

The pre-tokenizer is a deterministic transducer over character classes: a transition that opens a
new piece is marked. Texts are cut into chunks of fixed width; each chunk is run from every state at
once, which gives its state map (state before -> state after); a parallel prefix scan composes the
maps, so that every chunk's first state is known; a last pass reads the marks. What a piece adds to
the count is the annotation on its path in the lexicon transducer, which is compiled piece by piece
from the tokenizer's merges as pieces are met, and is equal to the library's own segmentation.

Nulls: null text is empty (0 bytes, 0 tokens). A null doc_id, ties, repeated rows and extra columns
don't matter: rows are counted one by one. Special strings in a text are one token each, as the
library takes them by default. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from . import arrays, tables

# Classes of characters. The last three depend on what follows: the last of a run of white space
# before other text (a blank, or another), and an apostrophe that may open a contraction of 2 or 3.
LETTER, NUMBER, OTHER, SPACE, LAST_BLANK, LAST_SPACE, SHORT, LONG, END = range(9)
# States: nothing open; in letters, numbers, others, white space; after a blank that the next piece
# takes along; one or two more characters of a contraction to come.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, TAKEN, ONE_MORE, TWO_MORE = range(8)


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark) by state and class."""
    step, mark = np.zeros((8, 9), dtype=np.uint8), np.zeros((8, 9), dtype=bool)
    opened = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: IN_SPACE, LAST_BLANK: TAKEN, LAST_SPACE: NEW, SHORT: ONE_MORE, LONG: TWO_MORE, END: NEW}
    same = {IN_LETTERS: {LETTER}, IN_NUMBERS: {NUMBER}, IN_OTHERS: {OTHER, SHORT, LONG}, IN_SPACE: {SPACE}}
    joins = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    for state in range(8):
        for kind in range(9):
            if state in (ONE_MORE, TWO_MORE) and kind != END:
                step[state, kind] = ONE_MORE if state == TWO_MORE else NEW
            elif state == TAKEN and kind in joins:
                step[state, kind] = joins[kind]
            elif kind in same.get(state, ()):
                step[state, kind] = state
            else:
                step[state, kind], mark[state, kind] = opened[kind], True
    return step, mark


STEP, MARK = transducer()
#: Beyond these code points, and outside the tags, Unicode has no letters, numbers or white space.
LAST, TAGS = 0x34000, range(0xE0000, 0xE1000)


@cache
def char_classes(path: str) -> np.ndarray:
    """The class of each code point as the tokenizer's own pattern has it: a letter goes on after a
    letter, a number after a number, another after a mark, and white space after none of them."""
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    points = np.array([c for c in (*range(LAST), *TAGS) if not 0xD800 <= c < 0xE000])
    for some in np.array_split(points, len(points) // 8192):
        chars = [chr(c) for c in some.tolist()]
        text = "".join(f"a{c}\n1{c}\n!{c}\n" for c in chars)
        opens = np.zeros(len(text) + 1, bool)
        opens[[span[0] for _, span in pre.pre_tokenize_str(text)]] = True
        breaks = opens[:-1].reshape(len(chars), 9)[:, [1, 4, 7]]
        kinds[some] = np.where(~breaks[:, 0], LETTER, np.where(~breaks[:, 1], NUMBER, np.where(~breaks[:, 2], OTHER, SPACE)))
    return kinds


def scan(kinds: np.ndarray, width: int = 256) -> np.ndarray:
    """The marks that the transducer, begun in NEW, gives over ``kinds``."""
    rows = -(-len(kinds) // width)
    cells = np.full(rows * width, END, dtype=np.uint8)
    cells[: len(kinds)] = kinds
    cells = np.ascontiguousarray(cells.reshape(rows, width).T)
    step = STEP.ravel()
    states = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, 1)
    for col in cells:
        states = step[states * np.uint8(9) + col]
    maps, hop = states, 1
    while hop < rows:  # inclusive prefix scan: maps[:, i] becomes the map of chunks 0 .. i
        maps = np.concatenate((maps[:, :hop], np.take_along_axis(maps[:, hop:], maps[:, :-hop], 0)), 1)
        hop *= 2
    state = np.concatenate((np.array([NEW], dtype=np.uint8), maps[NEW, :-1]))
    marks, mark = np.empty(cells.shape, dtype=bool), MARK.ravel()
    for j, col in enumerate(cells):
        at = state * np.uint8(9) + col
        marks[j] = mark[at]
        state = step[at]
    return marks.T.ravel()[: len(kinds)]


def classify(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes of code points; ``ends`` are the places of the segments' terminators."""
    kinds = classes[points]
    kinds[ends] = END
    after = np.append(kinds[1:], END)
    last = (kinds == SPACE) & (after != SPACE) & (after != END)
    blank = last & (points == 0x20)
    quote = np.flatnonzero((points == 0x27) & (kinds != END))
    kinds[last] = LAST_SPACE
    kinds[blank] = LAST_BLANK
    if len(quote):
        text = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = text[quote + 1], text[quote + 2]
        kinds[quote[np.isin(one, [ord(x) for x in "stmd"])]] = SHORT
        for pair in ("re", "ve", "ll"):
            kinds[quote[(one == ord(pair[0])) & (two == ord(pair[1]))]] = LONG
    return kinds


class Compiled:
    """The lexicon transducer of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = arrays.Merges(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs]))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cache = arrays.SegmentCache()
        self.classes = char_classes(path)

    def counts(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text."""
        special, cut_out = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        parts, owner = rows, np.arange(len(rows))
        for token in self.special:
            if any(token in x for x in parts):
                cut = [x.split(token) for x in parts]
                more = np.array([len(x) for x in cut])
                np.add.at(special, owner, more - 1)
                np.add.at(cut_out, owner, (more - 1) * len(token.encode()))
                owner, parts = np.repeat(owner, more), [y for x in cut for y in x]
        raw = [x.encode("utf-8", "surrogatepass") for x in parts]
        n_bytes = np.bincount(owner, [len(x) for x in raw], len(rows)).astype(np.int64) + cut_out
        data = np.frombuffer(b"\n".join([*raw, b"\0" * 8]), dtype=np.uint8)
        size = len(data) - 8
        head = np.flatnonzero((data[:size] & 0xC0) != 0x80)  # byte at which each character begins
        points = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(x) + 1 for x in parts]) - 1
        opens = np.flatnonzero(scan(classify(points, ends, self.classes)))
        starts = head[opens]
        stops = np.append(starts[1:], size)
        real = np.ones(len(points), dtype=bool)
        real[ends] = False
        keep = real[opens]
        starts, stops, at = starts[keep], stops[keep], opens[keep]
        if not len(starts):
            return n_bytes, special

        def compile_pieces(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lengths = stops[first] - starts[first]
            _, n = self.merges.many(self.byte_ids[data[arrays.spread(starts[first], lengths)]], lengths)
            return n.astype(np.int32), np.ones(len(first), dtype=np.int64)

        where, _, flat = self.cache.rows(arrays.hash_segments(data, starts, stops), compile_pieces)
        found = np.bincount(owner[np.searchsorted(ends, at)], flat[where], len(rows))
        return n_bytes, special + found.astype(np.int64)


@cache
def compiled(path: str) -> Compiled:
    return Compiled(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, chunk_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = compiled(path)
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // chunk_bytes, prepend=0))
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
                if b > a:
                    n_bytes, n = lexicon.counts(batch.column(1).slice(a, b - a).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return tables.texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
