"""Encoding, Huffman files, packing and token counts against the library itself."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from joinloom.llm import huffman, packing, token_counts
from joinloom.llm.encoding import Encoder

ODD = ["", " ", "a", "<|endoftext|> x<|startoftext|>", "don't I'LL 12'34 '' 's", "é́ é ß ẞ İ ŉ Ÿ ſ", "日本語 テキスト", "​\x00\x1f\x85\xa0", "\r\n\n\t x  \n", "a" * 3000, "ab " * 2000, "🙂🙂 🙂", "ẍy"]


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABC éèüßñ 0123456789 .,;:!?'\"()[]<>| \n\t"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(60)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_librarys(vocabulary, name):
    e, library = Encoder(vocabulary(name), most_words=50), Tokenizer.from_file(vocabulary(name))
    for text in [*texts(), *(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}'s" for c in range(1, 0x250) if unicodedata.category(chr(c)) != "Cs")]:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


ROWS = [(7, None), (3, ""), (None, "null id"), (3, "again"), (3, "again"), *((100 + i, t) for i, t in enumerate(texts()))]


def test_huffman_round_trip(spark, docs_of, vocabulary):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    folder = huffman.write_ids(docs_of(ROWS).repartition(3), vocabulary("byte_bpe_50k.json"), 0)
    got = huffman.read_ids(spark, folder, with_ids=True).collect()
    want = sorted(((-1 if i is None else i), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in ROWS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)


def test_huffman_of_nothing(spark, docs_of, vocabulary):
    assert huffman.read_ids(spark, huffman.write_ids(docs_of([]), vocabulary("byte_bpe_50k.json"), 0)).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for counts in (np.array([5]), np.array([0, 3, 0, 1]), rng.integers(0, 1000, 300), 2 ** np.arange(40)):
        lengths = huffman.code_lengths(counts, 12).astype(int)
        used = counts > 0
        assert lengths[used].max() <= 12 and (lengths[~used] == 0).all()
        assert (0.5 ** lengths[used]).sum() == (1 if used.sum() > 1 else 0.5)
    import heapq

    counts = rng.integers(1, 1000, 300)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (counts * huffman.code_lengths(counts, 20)).sum() == cost


def test_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 50, 2000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    (checkpoints, payload), = huffman.Coder(lengths).encode([ids])
    third = checkpoints[8:12]
    got, = huffman.Decoder(lengths).decode([(huffman.BLOCK, third, payload)])
    assert got.tolist() == ids[2 * huffman.BLOCK : 3 * huffman.BLOCK].tolist()


def test_packing(docs_of, vocabulary):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = packing.pack(docs_of(ROWS), vocabulary("word_bpe_49k.json"), window=64, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert 0 < r.length <= 64 and len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) <= 64
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in ROWS)
    single = {k: v for k, v in by_doc.items() if len({r.start for r in v}) == len(v)}
    rebuilt = [np.frombuffer(b"".join(r.ids for r in sorted(v, key=lambda r: r.start)), "<u4").tolist() for v in single.values()]
    assert all(ids in want for ids in rebuilt) and len(rebuilt) >= len(ROWS) - 2
    assert sum(r.length for r in got) == sum(map(len, want))
    # Little padding: no two sequences would fit into one.
    fills = sorted(sum(r.length for r in v) for v in by_sequence.values())
    assert fills[0] + fills[1] > 64


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 65) for _ in range(3000)), reverse=True)
    fit, room = packing.BestFit(64), []
    for n in lengths:
        which, offset = fit.place(n)
        fitting = [r for r in room if r >= n]
        if which == len(room):
            assert not fitting and offset == 0
            room.append(64)
        else:
            assert room[which] == min(fitting) and offset == 64 - room[which]
        room[which] -= n


def test_packing_of_nothing(docs_of, vocabulary):
    assert packing.pack(docs_of([]), vocabulary("word_bpe_49k.json")).count() == 0


def test_token_counts_of_huge_texts(docs_of, vocabulary):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé'12.-") for _ in range(rng.randrange(1, 9)))
    huge = [" ".join(word() for _ in range(3000)), "x" * 5000, ("y" * 700 + " ") * 9, "é " * 2500, " " * 4000, "<|endoftext|>" * 300 + " end"]
    rows = [*ROWS, *((1000 + i, t) for i, t in enumerate(huge))]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)
    got = token_counts.token_counts(docs_of(rows), vocabulary("word_bpe_49k.json"), huge=500, step=400, overlap=40).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(docs_of([]), vocabulary("word_bpe_49k.json")).count() == 0
