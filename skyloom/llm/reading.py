"""Reading level of each text by smoothed unigram models of the grade levels.

One unigram model per level is trained on labelled texts (majority of the
raters, ties left out). A text is parted into sentences; each sentence has a
posterior over the levels under the models, and the text gets the level with
the highest mean posterior. Averaging over sentences, not words, keeps a few
long sentences of another level from deciding for the whole text.

Only running English prose gets a level: at least ``MIN_WORDS`` words, mostly
words rather than numbers, most of them known to the models.

Scale: training counts are aggregated with map-side combine into at most
``BUCKETS`` hashed words, whatever the corpus holds, so that the broadcast model
has a fixed bound. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4)
MIN_WORDS = 40
#: A word of a text may be unknown to the models, but most are known in English prose.
MIN_KNOWN = 0.5
#: Of the blank-parted tokens of a text at least this share must be words.
MIN_WORD_SHARE = 0.6
#: Bound of the labelled texts the models are fitted on.
TRAINING_DOCS = 20_000
BUCKETS = 1 << 18
#: Words seen less often in the training texts are names and noise.
MIN_COUNT = 5
SMOOTHING = 0.5

WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % BUCKETS


def label_majority(labels: DataFrame) -> DataFrame:
    """``doc_id, level``: the level most raters gave; null levels, repeated rows and ties are left out."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").isin(*LEVELS)).select("doc_id", "reading_level", "rater").distinct()
    count = votes.groupBy("doc_id", "reading_level").agg(F.count("*").alias("n"))
    best = count.groupBy("doc_id").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "reading_level")).alias("all"))
    winners = F.filter("all", lambda x: x["n"] == F.col("top"))
    return best.where(F.size(winners) == 1).select("doc_id", F.get(winners, F.lit(0))["reading_level"].alias("level"))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCS) -> np.ndarray:
    """The models as a float array: one row of log probabilities per hashed word, NaN where unknown.

    Fitted on the ``limit`` labelled texts with the smallest hash of their id.
    """
    chosen = label_majority(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "level")

    def count(batches):
        for batch in batches:
            seen: dict[tuple[int, int], int] = {}
            for text, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in words_of(text):
                    k = (bucket(w), level)
                    seen[k] = seen.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in seen], pa.int32()), pa.array([level for _, level in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["b", "level", "n"]
            )

    counts = rows.mapInArrow(count, "b int, level int, n long").groupBy("b", "level").agg(F.sum("n").alias("n"))
    n = np.zeros((BUCKETS, len(LEVELS)))
    for r in counts.toLocalIterator():  # at most BUCKETS rows a level
        n[r["b"], LEVELS.index(r["level"])] = r["n"]
    known = n.sum(axis=1) >= MIN_COUNT
    total = n.sum(axis=0) + SMOOTHING * max(int(known.sum()), 1)
    model = np.full((BUCKETS, len(LEVELS)), np.nan)
    model[known] = np.log((n[known] + SMOOTHING) / total)
    return model


class Reader:
    """Scores texts within one worker."""

    def __init__(self, known: np.ndarray, logp: np.ndarray):
        rows = {int(b): tuple(map(float, p)) for b, p in zip(known, logp)}
        none = None

        class Words(dict):
            def __missing__(self, w: str):
                if len(self) > 500_000:
                    self.clear()
                p = self[w] = rows.get(bucket(w), none)
                return p

        self.lookup = Words()

    def level(self, text: str | None) -> int | None:
        """The level of a text, None if it is no English running prose."""
        if not text or len(text) < 2 * MIN_WORDS:
            return None
        n_words = known = n_tokens = 0
        posterior = np.zeros(len(LEVELS))
        sums = []
        lookup = self.lookup
        for sentence in SENTENCE.split(text):
            words = words_of(sentence)
            n_words += len(words)
            n_tokens += sentence.count(" ") + 1 if len(words) < 3 else len(words)
            found = [p for p in map(lookup.__getitem__, words) if p is not None]
            known += len(found)
            if len(found) >= 2:
                sums.append([sum(c) for c in zip(*found)])
        if n_words < MIN_WORDS or known < MIN_KNOWN * n_words or n_words < MIN_WORD_SHARE * n_tokens or not sums:
            return None
        s = np.array(sums)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        posterior = (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
        return LEVELS[int(np.argmax(posterior))]


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", limit: int = TRAINING_DOCS) -> DataFrame:
    """``key, reading_level``: one row per text that is English running prose.

    Null, empty, short and non-prose texts have no row; whole texts of any
    length are read; equal posteriors fall to the lower level; repeated rows
    stay repeated. Without labelled texts nothing is known and no row is given.
    """
    model = train(docs, labels, limit)
    known = np.flatnonzero(~np.isnan(model[:, 0])).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((known, model[known].astype(np.float32)))
    rows = docs.where("text IS NOT NULL").select(F.col(key).alias("k"), F.col("text").cast("binary").alias("t"))

    def run(batches):
        reader = Reader(*shared.value)
        for batch in batches:
            levels = [reader.level(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32())], names=["k", "level"])

    schema = f"k {docs.schema[key].dataType.simpleString()}, level int"
    return rows.mapInArrow(run, schema).where("level IS NOT NULL").withColumnsRenamed({"k": key, "level": "reading_level"})


def level_profile(levels: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many texts of each source have which level: ``source, reading_level, n_docs, share``."""
    each = levels.join(docs.select(key, F.coalesce("source", F.lit("")).alias("source")), key).groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"))
    share = F.round(F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy("source")), 6)
    return each.withColumn("share", share)
