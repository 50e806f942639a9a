"""Packing, token files and the encoder against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from blockwise.llm import packing, token_files, tokens

ODD = ["", "  two  spaces", "a  b", "tail ", "tail\n", "\n lead", " x", "a \n b", "I'm it's DON'T '' 's", "<|endoftext|> x", "漢字", "İstanbul ΣΑΣ", "5²6 ½", "a\tb\r\nc", "   ", "ẞ", "don’t – “q”", "x'll've", "é"]
SCHEMA = "doc_id long, text string, size int, Shard string"


def odd_texts(n: int = 400) -> list[str]:
    rng = random.Random(3)
    letters = " \n\t'abcXYZ019.,!éßÄµ²½’漢 ́sdmtl"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def ids_of(name: str, text: str | None) -> list[int]:
    return [*tokens.encoder(tokens.vocabulary(name)).whole.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    own, texts = tokens.Encoder(tokens.vocabulary(name)), odd_texts()
    for _ in range(2):
        ids, at = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in tokens.runs(at)] == [own.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    own = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    for text in ("one two three", "four five six seven", "one four"):
        ids, _ = own.encode(pa.array([text]))
        assert ids.tolist() == own.whole.encode(text, add_special_tokens=False).ids


def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(odd_texts(60))] + [(None, "no id", 1, "x"), (3, None, 1, "x"), (5, "same", 1, "x"), (5, "same", 1, "x"), (900, "word " * 3000, 1, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_packing_covers_every_text_and_fits(spark):
    rows, df = docs(spark)
    got = packing.pack(df, tokens.vocabulary("byte_bpe_50k.json")).collect()
    want = sorted((-1 if i is None else i, zlib.crc32(np.array(ids_of("byte_bpe_50k.json", t), "<u4").tobytes())) for i, t, *_ in rows if i != 900)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got if r.doc_id != 900) == want
    long = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 900)
    ids = np.array(ids_of("byte_bpe_50k.json", "word " * 3000), "<u4")
    assert [x[2] for x in long[1:]] == [1024] * (len(long) - 1) and sum(x[2] for x in long) == len(ids)
    assert all(c == zlib.crc32(ids[s : s + k].tobytes()) for _, s, k, c in long)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for at, k in sorted(parts):
            assert at == end
            end += k
        assert end <= 1024


def test_packing_is_tight():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1024) for _ in range(20000)]
    packer = packing.BestFit(1024, 1024)
    for k in lengths:
        packer.place(k)
    assert packer.begun <= 1.03 * sum(lengths) / 1024 and packer.open <= 1024


@pytest.mark.parametrize("size, open_most", [(1024, 1024), (64, 8), (30, 1)])
def test_packing_equals_a_plain_best_fit(size, open_most):
    rng = random.Random(4)
    lengths = [min(size, rng.choice([1, 2, size // 2, size, rng.randint(1, size)])) for _ in range(4000)]
    packer, free, begun, want = packing.BestFit(size, open_most), [], 0, []
    for k in lengths:
        fitting = [f for f in free if f >= k]
        if fitting:
            room = min(fitting)
            free.remove(room)
        else:
            room, begun = size, begun + 1
            if k < size and len(free) == open_most:
                free.remove(min(free))
        want.append(size - room)
        if room > k:
            free.append(room - k)
    assert [packer.place(k)[1] for k in lengths] == want and packer.begun == begun


def test_fullest_closes_first():
    packer = packing.BestFit(10, 2)
    assert [packer.place(k) for k in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty, tokens.vocabulary("byte_bpe_50k.json")).collect() == []
    assert token_files.round_trip(empty, tokens.vocabulary("word_bpe_49k.json")).collect() == []


def test_token_files_round_trip(spark, monkeypatch):
    rows, df = docs(spark)
    got = token_files.round_trip(df, tokens.vocabulary("word_bpe_49k.json")).collect()
    want = sorted((-1 if i is None else i, len(x := ids_of("word_bpe_49k.json", t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    end = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order[0] is None and in_order[1:] == sorted(in_order[1:])


def test_random_access_to_any_token():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**20, 3000), [0, 255, 256, 65535, 65536]]).astype(np.uint32)
    own = token_files.TokenFile(token_files.encode_file(np.array([7, 9]), np.array([0, 1]), np.array([0, 10, len(ids)]), ids))
    assert [own.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in ((0, 0), (0, 10), (2995, 3700), (511, 513), (10, len(ids))):
        assert own.run(a, b).tolist() == ids[a:b].tolist()
