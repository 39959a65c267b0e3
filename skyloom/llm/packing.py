"""Filling fixed-capacity containers with texts, none split that fits whole.

Bounded-space online best fit. A packer keeps a fixed number of open
containers, found through a bitset keyed by free space: an item goes where
least room would be left; if it fits nowhere and all are open, the fullest
closes. Each scan partition packs its own items in file order. The containers
still open at its end are taken apart and packed again with those of its
neighbours, so that only a few per ``FAN_IN`` partitions stay badly filled.

Sizes are counted and packed in one pass over the texts; only the few items of
open containers are shuffled. The packing of the first pass is written once, so
that a lost executor can't assign containers differently in a second run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.automaton import TokenAutomaton
from skyloom.llm.tokenize import TOKENIZER_DIR, Encoder, broadcast_automaton
from skyloom.storage import Scratch

CAPACITY = 2048
OPEN_BINS = 128
FAN_IN = 64
SECOND_PASS = 1 << 62


class BestFit:
    """Online best fit with at most ``open_bins`` open containers of ``capacity``.

    ``add`` returns the containers closed by it; ``close`` those still open. A
    container is a list of items. An item of size 0 fits into any open one.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits = 0
        self.by_room: dict[int, list[list]] = {}
        self.n = 0

    def _take(self, room: int) -> list:
        bins = self.by_room[room]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        self.n -= 1
        return out

    def _put(self, room: int, bin_: list) -> None:
        self.by_room.setdefault(room, []).append(bin_)
        self.bits |= 1 << room
        self.n += 1

    @staticmethod
    def _lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def add(self, size: int, item) -> list[list]:
        closed = []
        fits = self.bits >> size
        if fits:
            room = self._lowest(fits) + size
            bin_ = self._take(room)
        else:
            if self.n >= self.limit:
                closed.append(self._take(self._lowest(self.bits)))
            room, bin_ = self.capacity, []
        bin_.append(item)
        if room == size:
            closed.append(bin_)
        else:
            self._put(room - size, bin_)
        return closed

    def close(self) -> list[list]:
        out = [b for room in sorted(self.by_room) for b in self.by_room[room]]
        self.by_room, self.bits, self.n = {}, 0, 0
        return out


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of an item: one, unless it exceeds the capacity."""
    if n <= capacity:
        return [(0, n)]
    return [(a, min(capacity, n - a)) for a in range(0, n, capacity)]


PACKED = "container_id long, k {key}, piece int, start_token long, n_tokens int, position int"


def pack_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    vocabulary: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """``container_id, key, piece, start_token, n_tokens, position``: one row per piece.

    A text of at most ``capacity`` tokens is one piece (0); a longer one is cut
    into full containers and a rest. ``position`` is the token offset within the
    container. Null and empty texts have 0 tokens and lie in a container without
    taking room. Repeated keys are packed as often as they occur; an empty table
    gives no rows. Containers hold at most ``capacity`` tokens.
    """
    spark = docs.sparkSession
    automaton = broadcast_automaton(spark, vocabulary, folder)
    kind = docs.schema[key].dataType.simpleString()
    schema = PACKED.format(key=kind)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))

    def emit(out: dict, container: int | None, bin_: list) -> None:
        at = 0
        for k, piece, start, size in bin_:
            out["container_id"].append(container)
            out["k"].append(k)
            out["piece"].append(piece)
            out["start_token"].append(start)
            out["n_tokens"].append(size)
            out["position"].append(at)
            at += size

    def batch_of(out: dict, key_type: pa.DataType) -> pa.RecordBatch:
        types = [pa.int64(), key_type, pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    def empty() -> dict:
        return {c: [] for c in ("container_id", "k", "piece", "start_token", "n_tokens", "position")}

    def first(batches):
        part = TaskContext.get().partitionId()
        encoder = Encoder(TokenAutomaton.restore(automaton.value))
        packer, n, key_type = BestFit(capacity, open_bins), part << 33, None
        for batch in batches:
            out, key_type = empty(), batch.schema.field(0).type
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = sum(map(len, map(encoder.ids.__getitem__, encoder.words(data)))) if data else 0
                for i, (start, piece) in enumerate(pieces(size, capacity)):
                    for bin_ in packer.add(piece, (k, i, start, piece)):
                        emit(out, n, bin_)
                        n += 1
            yield batch_of(out, key_type)
        if key_type is not None:
            out = empty()
            for bin_ in packer.close():
                emit(out, None, bin_)
                # Where an item of an open container comes from orders the second pass.
                out["position"][-len(bin_):] = [part] * len(bin_)
            yield batch_of(out, key_type)

    packed = scratch.write(rows.mapInArrow(first, schema))
    rest = packed.where("container_id IS NULL").withColumn("_g", F.expr(f"position div {FAN_IN}"))
    groups = int(rest.agg(F.max("_g")).first()[0] or 0) + 1

    def second(batches):
        part = TaskContext.get().partitionId()
        packer, n, key_type = BestFit(capacity, open_bins), SECOND_PASS + (part << 33), None
        for batch in batches:
            out, key_type = empty(), batch.schema.field(1).type
            for k, piece, start, size in zip(*(batch.column(c).to_pylist() for c in ("k", "piece", "start_token", "n_tokens"))):
                for bin_ in packer.add(size, (k, piece, start, size)):
                    emit(out, n, bin_)
                    n += 1
            yield batch_of(out, key_type)
        if key_type is not None:
            out = empty()
            # The last open containers are few: their items are packed once more, the largest first.
            last = BestFit(capacity, 1 << 30)
            done = [b for item in sorted((i for b in packer.close() for i in b), key=lambda i: -i[3]) for b in last.add(item[3], item)]
            for bin_ in done + last.close():
                emit(out, n, bin_)
                n += 1
            yield batch_of(out, key_type)

    # A fixed mixed order: in order of size, containers would close before small items come to fill them.
    again = rest.repartition(groups, "_g").sortWithinPartitions(F.xxhash64("k", "piece"), "k", "piece", "start_token").drop("_g").mapInArrow(second, schema)
    return packed.where("container_id IS NOT NULL").unionByName(again).withColumnRenamed("k", key)


def container_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, the least containers possible by volume, and the fill."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return each.agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").cast("long").alias("tokens"), F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"), F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("fill"),
    )
