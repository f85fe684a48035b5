"""Token counts, token files and SentencePiece against the public libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SMALL, make_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from caselink.llm import common, sentencepiece_codec, token_counts, token_files

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "",
    " ",
    "   \n\n  x ",
    "<|endoftext|>",
    "A<|startoftext|>b <|endoftext|>  c<|ENDOFTEXT|>",
    "don't'sll'll'S",
    "a" * 3000,
    "á ́x é",
    "x\u0085y z w",
    "日本語テキスト 한국어 😀😀",
    "▁▁a▁ b",
    "ﬁ Ａ\u0000x",
    "</s><s> <unk> <0x41>",
    "..., e.g. v1.2.3-beta(4)!",
]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), SentencePieceProcessor(model_file=PIECES)


def split(ids, sizes):
    return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]


def agree(libraries, texts):
    by_bytes, by_words, by_pieces = libraries
    assert token_counts.counter(BYTES).count(texts) == [len(by_bytes.encode(t, add_special_tokens=False).ids) for t in texts]
    assert split(*token_files.encoder(WORDS).encode(texts)) == [by_words.encode(t, add_special_tokens=False).ids for t in texts]
    coder = sentencepiece_codec.codec(PIECES)
    ids = split(*coder.encode(texts))
    assert ids == [by_pieces.encode(t) for t in texts]
    assert [coder.decode(i) for i in ids] == [by_pieces.decode(i) for i in ids]


def test_odd_texts(libraries):
    agree(libraries, ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(libraries, texts):
    agree(libraries, texts)


def test_pieces_in_random_order(libraries):
    r = random.Random(1)
    lib = libraries[2]
    texts = ["".join(lib.id_to_piece(r.randrange(259, 32000)).replace("▁", " ") for _ in range(40)) for _ in range(400)]
    agree(libraries, texts)


def test_long_texts_are_cut_without_effect(libraries, monkeypatch):
    text = " ".join(["Thonre was, is anly hend  and it's 12 oftionnt.\n"] * 50)
    assert "".join(common.pieces(text, 100)) == text and len(list(common.pieces(text, 100))) > 5
    for module in (token_counts, token_files, sentencepiece_codec):
        monkeypatch.setattr(module, "pieces", lambda t: common.pieces(t, 100))
    agree(libraries, [text, "x" * 500, text + text])


def test_small_word_store_gives_the_same():
    store = common.WordStore(lambda words: (np.array([len(w) for w in words]), np.ones(len(words), int)), most=3)
    for words in (["a", "bb"], ["ccc", "dddd", "a"], ["a", "bb", "ccc", "dddd", "eeeee"]):
        ids, sizes = store.ids(words, np.array([1, len(words) - 1]))
        assert ids.tolist() == [len(w) for w in words] and sizes.tolist() == [1, len(words) - 1]


def test_whole_tokens_are_proved():
    whole = set(token_counts.counter(BYTES).whole)
    assert " the" in whole and len(whole) > 40_000


def expected_rows(spark, encode):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: encode(r["text"] or "") for r in sorted(docs, key=lambda r: r["doc_id"])}


def test_count_tokens(spark, libraries):
    expected = expected_rows(spark, lambda t: (len(t.encode()), len(libraries[0].encode(t, add_special_tokens=False).ids)))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r[0]: r[1:] for r in token_counts.count_tokens(docs, BYTES).collect()}
    assert got == {k: (b, n, n > 512) for k, (b, n) in expected.items()}


def test_token_files(spark, libraries):
    expected = expected_rows(spark, lambda t: libraries[1].encode(t, add_special_tokens=False).ids + [1])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in token_files.token_file_digests(spark, docs, WORDS).collect()}
    start = 0
    for doc_id, ids in expected.items():
        row = got.pop(doc_id)
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not got


def test_token_files_of_several_partitions(spark, make_docs, tmp_path):
    docs = make_docs(*[(i, f"word {i} the") for i in range(50)], (None, "no id"), (7, "again"), (60, None), (61, ""))
    index = token_files.write_token_files(docs, WORDS, str(tmp_path), partitions=4)
    rows = sorted(index.collect(), key=lambda r: r["part"])
    assert len(rows) > 1 and [r["base"] for r in rows] == list(np.cumsum([0, *(r["n_ids"] for r in rows)])[:-1])
    assert all(len(token_files.TokenFile(r["file"], r["width"])) == r["n_docs"] for r in rows)
    got = sorted(token_files.read_token_files(index).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *range(8), *range(7, 50), 60, 61]
    assert [r["n_tokens"] for r in got[-2:]] == [1, 1]
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1])


def test_sentencepiece_round_trip(spark, libraries):
    lib = libraries[2]
    expected = expected_rows(spark, lambda t: (lib.encode(t), t))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    encoded = sentencepiece_codec.with_token_ids(docs, PIECES)
    for row in sentencepiece_codec.with_decoded(encoded, PIECES).collect():
        assert (row["token_ids"], row["decoded"]) == expected[row["doc_id"]]
    for row in sentencepiece_codec.encoded_digests(docs, PIECES).collect():
        ids, text = expected[row["doc_id"]]
        assert (row["n_tokens"], row["decoded_chars"]) == (len(ids), len(text))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_edge_rows(spark, make_docs):
    docs = make_docs((1, None), (1, None), (None, "the"), (2, ""), extra=True)
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(docs, BYTES).collect()) == [0, 0, 0, 1]
    assert sorted(r["n_tokens"] for r in token_files.token_file_digests(spark, docs, WORDS).collect()) == [1, 1, 1, 2]
    assert sorted(r["n_tokens"] for r in sentencepiece_codec.encoded_digests(docs, PIECES).collect()) == [0, 0, 0, 1]
    assert sorted(len(r["token_ids"]) for r in sentencepiece_codec.with_token_ids(docs, PIECES).collect()) == [0, 0, 0, 1]
    none = docs.limit(0)
    assert token_counts.count_tokens(none, BYTES).collect() == []
    assert token_files.token_file_digests(spark, none, WORDS).collect() == []
    assert sentencepiece_codec.encoded_digests(none, PIECES).collect() == []
