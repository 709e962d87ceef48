import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from loomery.llm.pieces import MergeEncoder, decode_table, encode_digests, encode_table  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tool():
    return MergeEncoder(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    fixed = ["", " ", "  ", "\n", " a", "a ", "a  b", "\n a\n\nb ", "▁x ▁", "naïve café", "日本語テキスト", "😀 emoji\t tab", "\x00\x01", "a" * 500, " " * 333 + "x", "x" + " " * 95, "<s> </s> <unk> <0x41>", "１２３ 12345 9", "   nbsp"]
    letters = "abcdefghijklmnopqrstuvwxyz     \n,.éèäößñ0123456789#*ABC▁漢😀\t"
    words = ["the", "tion", "ing", "ouvipa", "internationalization", "Ungbege", "  ", "\n", "&amp;", "http://x.y/z?a=b", "token = 12", "été"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(300)] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(200)]


def test_same_ids_and_text_as_library(tool, library):
    for text in texts():
        ids = library.encode(text)
        assert tool.encode(text) == ids, repr(text)
        assert tool.decode(ids) == library.decode(ids), repr(text)


def test_decode_of_any_ids(tool, library):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randrange(1, 12))]
        assert tool.decode(ids) == library.decode(ids), ids


def test_tables(spark, library):
    rows = [(1, "a b\nc", "x"), (2, None, None), (3, "", "y"), (1, "a b\nc", "x"), (None, "é" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = decode_table(encode_table(docs, PATH), PATH).collect()
    assert sorted((r.decoded for r in back), key=len) == sorted(((t or "") for _, t, _ in rows), key=len)
    assert encode_digests(docs, PATH).count() == 5
    assert encode_digests(docs.limit(0), PATH).count() == 0
