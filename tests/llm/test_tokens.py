import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece

from tidewater.llm.pieces import vocab
from tidewater.llm.spm_codec import codec_of, digests, encode_decode
from tidewater.llm.token_counts import RankMerger, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "hello world", "  two  spaces ", "a\nb\t c\r\n", "", None, "<s>hi</s><unk><0x0A>", "é日本語😀\x00", "▁x ▁▁ y", " ",
    "the" * 700, "=" * 333, "=-" * 500, " " * 100, "日本" * 300, "naïve façade " * 50, "a" * 3000, "\n" * 50, "hello world",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "x y", "x", 1, 2)], "doc_id long, text string, id string, n_tokens int, decoded int")


def test_counts_equal_the_library(docs, library):
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in [*enumerate(TEXTS), (None, "x y")]:
        assert (got[i].n_tokens, got[i].n_bytes) == (len(library.encode(t or "")), len((t or "").encode()))


def test_rounds_equal_heap(library):
    merger = RankMerger(vocab(PATH))
    words = [w for t in TEXTS if t for w in vocab(PATH).segments(t)]
    assert merger.counts(words) == [merger._by_heap(merger.symbols(w)[0]) + merger.symbols(w)[1] for w in words]


def test_codec_equals_the_library(docs, library):
    coded = encode_decode(docs, PATH)
    got = {r.doc_id: r for r in coded.collect()}
    short = {r.doc_id: r for r in digests(coded).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids_le == struct.pack(f"<{len(ids)}I", *ids)
        assert got[i].decoded == library.decode(ids)
        assert short[i].n_tokens == len(ids)
        assert short[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_decode_of_broken_bytes(library):
    ids = [library.piece_to_id(p) for p in ("<0xE6>", "<0x97>", "▁a", "<0xFF>", "<0xC3>", "<0xA9>")]
    assert codec_of(PATH).decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(none, PATH).collect() == [] and encode_decode(none, PATH).collect() == []
