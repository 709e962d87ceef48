import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from loomery.llm.unigram import UnigramCounter, count_tokens, read_vocabulary  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary):
    entries = [("<unk>", 0.0), *vocabulary.items(), *((f"<0x{b:02X}>", -1.0) for b in range(256))]
    return tokenizers.Tokenizer(tokenizers.models.Unigram(entries, unk_id=0, byte_fallback=True))


def texts(letters, n=400):
    rng = random.Random(3)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))) for _ in range(n)]


def test_same_counts_as_library():
    vocabulary = read_vocabulary(PATH)
    ours, theirs = UnigramCounter(vocabulary), library(vocabulary)
    for text in [*texts("abcdefghi  tion\né漢😀"), "the quick brown fox " * 200, " " * 50, "a  b   c", "x" * 400]:
        marked = ("▁" + text).replace(" ", "▁") if text else ""
        assert ours.count(text)[0] == len(theirs.encode(marked, add_special_tokens=False).ids), repr(text)


def test_ties_and_fractions_over_whole_texts():
    tied = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, "▁a": -2.0}
    odd = {k: v * 0.37 for k, v in tied.items()}
    for vocabulary in (tied, odd):
        ours, theirs = UnigramCounter(vocabulary), library(vocabulary)
        assert ours.apart == (vocabulary is tied)
        for text in texts("ab "):
            marked = ("▁" + text).replace(" ", "▁") if text else ""
            assert ours.count(text)[0] == len(theirs.encode(marked, add_special_tokens=False).ids), repr(text)


def test_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (1, "a b", "x"), (None, "é" * 5000, "z")], "doc_id long, text string, n_tokens string")
    rows = count_tokens(docs, PATH).collect()
    assert len(rows) == 5 and [r.n_tokens for r in rows if not r.text] == [0, 0]
    assert count_tokens(docs.limit(0), PATH).count() == 0
