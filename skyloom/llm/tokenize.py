"""Encoding of a whole corpus with a public byte-level vocabulary, and back.

A text is split into words by the pattern that belongs to the vocabulary, and
each word is encoded by the tokenization automaton. Words repeat, so a worker
keeps the ids of those it has seen; that memory is bounded and only saves time.
The automaton depends on the vocabulary alone (a few MB) and is compiled once
and broadcast. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.automaton import TokenAutomaton, read_ranks

#: Where the vocabulary files are; a parameter of every function.
TOKENIZER_DIR = "/opt/tokenizers"
#: The split pattern of the byte-level vocabularies, for ASCII texts and for all texts.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
ALL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

CACHED_WORDS = 400_000
CACHED_LENGTH = 48


class WordIds(dict):
    """Ids of words, encoded when first asked for."""

    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        ids = tuple(self.automaton.encode(word.encode("utf-8", "surrogatepass")))
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Splits and encodes whole texts within one worker."""

    def __init__(self, automaton: TokenAutomaton):
        import regex

        self.ids = WordIds(automaton)
        self.ascii_words = re.compile(ASCII_WORDS).findall
        self.all_words = regex.compile(ALL_WORDS).findall

    def words(self, data: bytes) -> list[str]:
        if data.isascii():
            return self.ascii_words(data.decode("ascii"))
        return self.all_words(data.decode("utf-8", "replace"))

    def encode(self, data: bytes | None) -> list[int]:
        """Ids of a UTF-8 text; null and empty texts have none, broken bytes count as U+FFFD."""
        if not data:
            return []
        return list(chain.from_iterable(map(self.ids.__getitem__, self.words(data))))


@functools.lru_cache(maxsize=4)
def compile_automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(read_ranks(path))


def broadcast_automaton(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The state of the compiled automaton as a broadcast variable; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(vars(compile_automaton(f"{folder}/{vocabulary}.tiktoken")))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, without special tokens.

    Null and empty texts have an empty list; any characters and lengths are
    encoded whole. One row per input row: repeated rows stay, other columns are
    not read. An empty table gives no rows.
    """
    automaton = broadcast_automaton(docs.sparkSession, vocabulary, folder)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))

    def run(batches):
        encoder = Encoder(TokenAutomaton.restore(automaton.value))
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for data in batch.column(1).to_pylist():
                if data:
                    flat += chain.from_iterable(map(encoder.ids.__getitem__, encoder.words(data)))
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])

    schema = f"k {docs.schema[key].dataType.simpleString()}, ids array<int>"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"k": key, "ids": ids})


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and the text its ids spell; null ids give null, an empty list an empty text."""
    automaton = broadcast_automaton(encoded.sparkSession, vocabulary, folder)
    rows = encoded.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("i"))

    def run(batches):
        labels = TokenAutomaton.restore(automaton.value)
        for batch in batches:
            texts = [None if x is None else labels.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "t"])

    schema = f"k {encoded.schema[key].dataType.simpleString()}, t string"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"k": key, "t": text})


