"""Token counts, token files and pieces against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from recollect.llm import pieces, repair, tokencount


def noise(rng, letters, n=1500):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 70))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_are_the_library_s(spark, byte_bpe, texts, rng):
    rows = list(texts.values()) + noise(rng, " \n\t'stmdrevlab9é½!?😀 \x85\x1c") + ["x" * 400 + " " * 50 + "y" * 2000, "don't 'twas 've'll'l'r're", "<|endoftext|>a<|endoftext|> b", " nbsp x　y "]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs).collect()}
    want = [len(e.ids) for e in byte_bpe.encode_batch(rows, add_special_tokens=False)]
    assert got == {i: (len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip(rows, want, strict=True))}


def test_state_maps_compose():
    kinds = np.random.default_rng(3).integers(0, 9, 5000).astype(np.uint8)
    state, want = tokencount.NEW, []
    for k in kinds.tolist():
        want.append(bool(tokencount.MARK[state, k]))
        state = tokencount.STEP[state, k]
    for width in (3, 64, 256, 10_000):
        assert tokencount.scan(kinds, width).tolist() == want


def test_files_are_the_library_s(spark, texts, rng):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = list(texts.values()) + noise(rng, " \n\tabcdé9'!?<|>Ⅸ́", 400) + ["", "a<|endoftext|>b <|startoftext|>"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.token_files(docs).collect()}
    start, want = 0, {}
    for i, e in enumerate(library.encode_batch(rows, add_special_tokens=False)):
        ids = np.array([*e.ids, 2], dtype="<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_shards_decode_at_random_places(rng):
    ids = np.array([rng.choice([5, 6, 7, 5, 6, 9, 40_000]) for _ in range(30_000)] + [3] * 500)
    shard = repair.Shard(repair.pack(ids, np.array([1, 2]), np.array([10_000, 20_500])))
    assert len(shard.seq) < len(ids) / 2 and len(shard.left) > 0
    assert shard.ids().tolist() == ids.tolist()
    for _ in range(200):
        a, n = rng.randrange(0, len(ids)), rng.randrange(0, 300)
        assert shard.read(a, n).tolist() == ids[a : a + n].tolist()
    for few in ([], [4], [4, 4], [4] * 100):
        one = repair.Shard(repair.pack(np.array(few, dtype=np.int64), np.array([1]), np.array([len(few)])))
        assert one.ids().tolist() == few and one.read(0, 10).tolist() == few[:10]


def test_pieces_without_dropout_are_the_library_s(spark, texts, rng):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = list(texts.values()) + noise(rng, " \n\tabcdehinorst é日😀.,") + ["", " ", "  a", "x" * 700 + " " * 40 + "y" * 300]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.ids) for r in pieces.encode(docs, dropout=0.0).collect()}
    assert got == dict(enumerate(library.encode(rows)))


def test_dropout_varies_and_loses_nothing(spark, rng):
    rows = [(i, "segmentation varies between occurrences " * 20) for i in range(6)] + [(10 + i, t) for i, t in enumerate(noise(rng, " \n\tab▁ é日😀.,", 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pieces.encode(docs, dropout=0.3).collect()
    assert all(r.lossless for r in out) and len({tuple(r.ids) for r in out if r.doc_id < 6}) == 6
    assert {tuple(r) for r in pieces.encode(docs.repartition(7), dropout=0.3).select("doc_id", "ids_crc32").collect()} == {(r.doc_id, r.ids_crc32) for r in out}
    assert {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs, dropout=0.3)).collect()} == set(rows)


def test_dropout_against_a_plain_loop(rng):
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    words = [f" {w}" for w in "the segmentation of words varies between all their occurrences é日😀".split()] * 3
    text = "".join(rng.choice(words) for _ in range(400)).encode()
    keys = np.array([12345], dtype=np.uint64)
    bar = np.uint64(0.3 * float(2**64 - 2049))
    want = []
    for number, word in enumerate(text.decode().split(" ")[1:]):
        unit = (("  " if number == 0 else " ") + word).encode()
        ids, _ = model.symbols(np.frombuffer(unit, dtype=np.uint8), np.array([0]), np.array([len(unit)]))
        row, spots = ids.tolist(), list(range(len(ids)))
        draw = pieces.arrays.mix(keys ^ pieces.arrays.mix(np.array([number + 17], dtype=np.uint64)))
        while True:
            open_pairs = []
            for i in range(len(row) - 1):
                found = model.merges.one(row[i], row[i + 1])
                mark = pieces.mark_of(*(np.array([x]) for x in (spots[i], row[i], row[i + 1])))
                if found and not (pieces.arrays.mix(draw ^ mark) < bar)[0]:
                    open_pairs.append((found[0], i, found[1]))
            if not open_pairs:
                break
            _, i, merged = min(open_pairs)
            row[i : i + 2] = [merged]
            del spots[i + 1]
        want += row
    for block in (100_000, 7):
        got, size = model.encode([text], keys, 0.3, 17, block)
        assert got.tolist() == want and size.tolist() == [len(want)]


def test_agenda_and_blocks_agree():
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    word = "▁internationalisation".replace("▁", " ").encode()
    data = np.frombuffer(word + b"\0" * 8, dtype=np.uint8)
    flat, size = model.symbols(data, np.array([0]), np.array([len(word)]))
    skip = lambda rows, spots, left, right: (spots + left + right) % 3 == 0
    block, _ = model.merges.many(flat, size, skip)
    heap, _ = model.merges.many(flat, size, skip, longest=1)
    assert block.tolist() == heap.tolist()


def test_odd_rows(odd, empty):
    for f in (tokencount.token_counts, repair.token_files, pieces.encode):
        assert f(odd).count() == odd.count() and f(empty).count() == 0
    assert {r.n_tokens for r in tokencount.token_counts(odd).collect() if r.doc_id in (1, 2)} == {0}
    assert {r.n_tokens for r in repair.token_files(odd).collect() if r.doc_id in (1, 2)} == {1}
    assert all(r.lossless for r in pieces.encode(odd).collect())


def test_no_pair_that_pays_is_left_and_ranges_of_the_corpus_read_back(spark):
    rng = np.random.default_rng(2)
    for t in range(30):
        ids = np.minimum(rng.zipf(1.5, int(rng.integers(0, 2000))), [3, 20, 1000][t % 3]).astype(np.int32)
        ids = np.tile(ids[:40], 20) if t % 5 == 0 else ids
        shard = repair.Shard(repair.pack(ids, np.zeros(1, np.int64), np.array([len(ids)])))
        assert (shard.ids() == ids).all()
        places = {}
        for i, pair in enumerate(zip(shard.seq[:-1].tolist(), shard.seq[1:].tolist(), strict=True)):
            have = places.setdefault(pair, [])
            if not have or have[-1] < i - 1:
                have.append(i)
        assert max(map(len, places.values()), default=0) < 4
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 7)) for i in range(60)], "doc_id long, text string").repartition(4)
    shards = repair.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), shard_ids=100)
    whole = [i for r in sorted(repair.read_ids(shards, 0, 10**9).collect()) for i in r.ids]
    assert whole.count(2) >= 60
    got = [i for r in sorted(repair.read_ids(shards, 137, 300).collect()) for i in r.ids]
    assert got == whole[137:437]


def test_characters_of_every_kind_count_as_the_library_counts_them():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"x{chr(c)} {chr(c)}a 1{chr(c)}" for c in (*range(0, 0xD800, 3), 0x1C89, 0xA7CB, 0x105C0, *range(0x10000, 0x34000, 17), 0x10FFFF)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert tokencount.compiled(path).counts(texts)[1].tolist() == want


def test_distinct_hashes_as_numpy_finds_them():
    from recollect.llm import arrays

    rng = np.random.default_rng(0)
    for keys in (rng.integers(0, 50, 1000).astype(np.uint64), arrays.mix(rng.integers(0, 500, 3000).astype(np.uint64)), np.zeros(0, np.uint64)):
        for a, b in zip(arrays.distinct(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert a.tolist() == b.tolist()


def test_letters_alone_go_to_the_model_as_bytes_are_shown():
    """Words of a-z, ß-ö, ø-ÿ alone are told by their bytes, and stretches of equal ids are halved."""
    import re

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from recollect.llm import repair

    texts = ["straße größe ÷ø ÷ à÷à þÿ ÞÀ éééx x́ naïve Ã ß÷ ǽ ā 東京 ab1c ÿ", "", "ÿ", "ß", "Ã\u009f aÂb ñandú"]
    words = " ".join(texts).split(" ")
    data = np.frombuffer("\n".join(words).encode() + b"\n" + b"\0" * 8, dtype=np.uint8)
    upto, at = repair.plain_letters(data, len(data) - 8), 0
    for word in words:
        end = at + len(word.encode())
        assert (upto[at] == upto[end]) == (re.fullmatch("[a-zß-öø-ÿ]*", word) is not None), word
        at = end + 1
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), repair.word_encoder(path)
    for _, ids, size in mine(pa.array(texts)):
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and len(size) == len(texts)
    for ids in (np.full(1001, 7), np.array([1, 1, 1, 2] * 50 + [3, 3] * 31 + [5] * 9)):
        payload = repair.pack(ids.astype(np.int32), np.array([1]), np.array([len(ids)]))
        assert np.array_equal(repair.Shard(payload).ids(), ids)
