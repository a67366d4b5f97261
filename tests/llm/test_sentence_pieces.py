"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from harborline.llm import sentence_pieces as s

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a", "a  ", "▁", "▁x ▁", "\x00", "a\x00b", "<s>", "</s> <unk>", "<0x41>", "😀😀 日本語テキスト 梦", "\n\n  \n\t x",
    "a" * 500, " " * 50, "▁" * 40 + "ab", "�", "é", "﻿x",
]


@pytest.fixture(scope="module")
def coder():
    return s.Coder(s.read_pieces(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_odd_and_random_texts(coder, library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab cdeé\n\t▁ 日本😀<>s/0x1Тест  ", k=rng.randint(0, 60))) for _ in range(3000)]
    for ends in (True, False):
        for text in texts:
            ids = np.frombuffer(coder.encode(text, ends, ends), "<u4").tolist()
            assert ids == library.encode(text, add_bos=ends, add_eos=ends), text
            assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(coder, library):
    rng = random.Random(2)
    draw = (lambda: rng.randrange(3), lambda: rng.randrange(3, 259), lambda: rng.randrange(32000), lambda: 29871, lambda: 259)
    for _ in range(3000):
        ids = [rng.choice(draw)() for _ in range(rng.randint(0, 12))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_the_best_pair_merges_first_and_ties_from_the_left(coder):
    """The agenda against a search for the best pair before each merge."""

    def plain(segment):
        symbols, place = list(segment), coder.pieces.place
        while True:
            pairs = [(place[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in place]
            if not pairs:
                return symbols
            _, i = min(pairs)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    rng = random.Random(3)
    for _ in range(500):
        segment = s.BLANK + "".join(rng.choices("aeinstr▁", k=rng.randint(1, 30)))
        assert coder.merged(segment) == plain(segment)


def test_texts_are_only_cut_where_no_piece_reaches(coder):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("ab1\n▁é梦😀 ", k=rng.randint(1, 40)))
        whole = s.BLANK + text.replace(" ", s.BLANK)
        cut = list(coder.cut(text))
        assert "".join(cut) == whole
        assert [x for part in cut for x in coder.merged(part)] == coder.merged(whole) == coder._merged_by_heap(whole)


def test_a_full_store_and_a_long_stretch(monkeypatch, library):
    monkeypatch.setattr(s, "HELD_SEGMENTS", 5)
    coder = s.Coder(s.read_pieces(PATH))
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(400)) + " " + "".join(rng.choices("abc", k=20_000))
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert len(coder.held) <= 5 and len(coder.older) <= 5


def test_a_difference_to_the_library_is_found(monkeypatch):
    coder = s.Coder(s.read_pieces(PATH))
    library = s.Library(coder)
    texts = ["one two", "three", "two"]
    true = coder.pieces.place["▁two"]
    coder.pieces.place["▁two"] = s.NO_PIECE
    ids = [coder.encode(x) for x in texts]
    assert library.agrees(texts, [coder.decode(x) for x in ids]) == [False, True, False]
    assert library.agrees(["three"], ["tree"]) == [False]
    coder.pieces.place["▁two"] = true


def test_long_texts_are_cut_as_short_ones(monkeypatch, coder):
    text = "a b  c\nd" * 30
    listed = list(coder.cut(text))
    monkeypatch.setattr(s, "LONG_TEXT", 10)
    assert list(coder.cut(text)) == listed


def test_unsupported_vocabularies_are_an_error():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        s.Pieces(proto.SerializeToString())
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.pieces[500].type = 4
    with pytest.raises(ValueError):
        s.Pieces(proto.SerializeToString())


def test_frames(spark, library):
    vocabulary = s.read_pieces(PATH)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null key"), (3, "again"), (3, "again"), (99, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, key int").repartition(3)
    coded = s.encode_texts(df, vocabulary)
    got = sorted((str(r.doc_id), bytes(r.ids), r.n_tokens, r.decoded, r.agrees) for r in coded.collect())
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((str(key), np.array(ids, "<u4").tobytes(), len(ids), library.decode(ids), True))
    assert got == sorted(want)
    back = s.decode_ids(coded, vocabulary).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((g[0], g[3]) for g in got)
    unchecked = s.encode_texts(df, vocabulary, begin=False, end=False, check=False).where("doc_id = 99").first()
    assert (unchecked.n_tokens, unchecked.decoded, unchecked.agrees) == (0, "", None)
    assert s.encode_texts(df.limit(0), vocabulary).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert s.decode_ids(null, vocabulary).first().decoded is None


def test_query_on_the_table(spark, sf_small, library):
    from harborline.llm import queries as q

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = q.op11_sentence_pieces(spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_agendas_side_by_side_equal_single_ones():
    vocabulary = s.read_pieces(PATH)
    rng = random.Random(11)
    letters = "aeinorstlu  \n\t é世ß▁🙂\x00ABq.,-'"
    texts = ["", " ", "a", "aaaaaaaaaaaaaaaa", "x" * 41, "🙂", *("".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(600))]
    coder = s.Coder(vocabulary)
    got = [y for i in range(0, len(texts), 37) for y in coder.encode_all(texts[i : i + 37])]
    single = s.Coder(vocabulary)
    assert got == [single.encode(x) for x in texts]
    assert coder.encode_all([]) == [] and coder.encode_all(texts, False, False) == [x[4:-4] for x in got]
    assert all(len(x) <= s.HELD_LENGTH for x in coder.held)
