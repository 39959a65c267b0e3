"""Tokenization automaton and corpus encoding (p6)."""

import os
import random

import pytest

from skyloom.llm import tokenize as T
from skyloom.llm.automaton import TokenAutomaton

VOCABULARY = f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def merge(ranks, word):
    """Brute-force merging: always the adjacent pair of the lowest rank, the leftmost first."""
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def random_vocabulary(rng, merges):
    """A vocabulary as training would leave it: each merge joins two adjacent tokens of some encoded text."""
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 256 + merges:
        word = bytes(rng.choice(b"abc") for _ in range(12))
        ids = merge(ranks, word)
        labels = {i: t for t, i in ranks.items()}
        if len(ids) > 1:
            k = rng.randrange(len(ids) - 1)
            ranks.setdefault(labels[ids[k]] + labels[ids[k + 1]], len(ranks))
    return ranks


def test_automaton_agrees_with_merging():
    rng = random.Random(1)
    for _ in range(40):
        ranks = random_vocabulary(rng, rng.randrange(1, 25))
        automaton = TokenAutomaton(ranks)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 30)))
            assert automaton.encode(word) == merge(ranks, word)
            assert automaton.decode(automaton.encode(word)) == word


def test_missing_byte_is_refused():
    with pytest.raises(ValueError):
        TokenAutomaton({b"a": 0})


@needs_vocabulary
def test_agrees_with_the_library_on_any_text():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{T.TOKENIZER_DIR}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    encoder = T.Encoder(T.compile_automaton(VOCABULARY))
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(0x300), *range(0x2000, 0x2070), *range(0x3040, 0x30FF), 0xFEFF, 0x1F680, 0x10FFFF, 0xE000, 0x180E]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(" \n\t're5ab\x1c\x85\xa0") for _ in range(30)) for _ in range(500)] + ["a" * 20_000, " " * 5_000, "<|endoftext|> x", "ab" * 5_000, "👩‍🚀" * 50, "0" * 999]
    for text in texts:
        assert encoder.encode(text.encode()) == reference.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_corpus_and_round_trip(spark):
    data = [(1, "Stars glow."), (2, None), (3, ""), (4, "  "), (5, "x" * 100_000), (5, "twice"), (None, "no id"), (6, "naïve ☉\r\n\t")]
    docs = spark.createDataFrame([(*d, 1, "t") for d in data], "doc_id long, text string, ids int, k string")
    got = T.encode_texts(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    by = {r["doc_id"]: list(r["ids"]) for r in got.where("doc_id <> 5").collect()}
    assert by[2] == [] and by[3] == [] and by[4] and got.count() == 8
    back = sorted((r["doc_id"], r["text"]) for r in T.decode_ids(got).where("doc_id IS NOT NULL").collect())
    assert back == sorted((i, t or "") for i, t in data if i is not None)
    assert T.encode_texts(docs.limit(0)).count() == 0
