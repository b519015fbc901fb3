"""Token counts against the libraries' whole-text encoding."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polisgraph.llm import tokencount

PARTS = ["a", "b'", " ", "  ", "\n", " \n", "<|endoftext|>", "é", "　", "\xa0", "\x1c", "\x85", "'s", "12", "!?", "<|", "|>", "endoftext", "日本", "́", "\t", "don't ", "▁", " ▁ "]


def mixed(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def whole(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    library = Tokenizer.from_file(path)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("piece", [4, 40])
def test_pieces_of_any_text_add_up(name, piece):
    library, count = tokencount.Library(public_tokenizers.path(name)), whole(public_tokenizers.path(name))
    texts = mixed(2000)
    for text in texts:
        raw = text.encode()
        ranges = list(tokencount.pieces(memoryview(raw), 0, len(raw), library.space == " ", piece)) if raw and library.cuts else []
        parts = [raw[a:b].decode() for a, b in ranges] or [text]
        assert sum(library.count(parts) if text else []) == count(text), text
    assert library.cuts == (name != "word_bpe_49k.json")


def test_query_columns_and_defined_cases(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    count = whole(path)
    texts = [*mixed(40, seed=2), None, "", "x " * 400_000, "y" * 300_000, "<|endoftext|>", "one two", "one two"]
    rows = [(k, t, "w") for k, t in enumerate(texts)] + [(None, "no id", None), (1, texts[1], "again")]
    found = tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(k), len((t or "").encode()), count(t or ""), count(t or "") > 1024) for k, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == want


def test_empty_table(spark):
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    count = whole(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, count(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_tokens) for r in tokencount.op11_token_counts(spark, sf).collect()) == want
