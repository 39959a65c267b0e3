"""Containers of fixed capacity (p7)."""

import os
import random

import pytest

from skyloom.llm import packing as P
from skyloom.llm import tokenize as T

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary file")


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(50):
        capacity, limit = rng.randrange(5, 60), rng.randrange(1, 8)
        packer, open_, closed, want = P.BestFit(capacity, limit), [], [], []
        for i in range(200):
            size = rng.randrange(0, capacity + 1)
            closed += packer.add(size, (i, size))
            fits = [b for b in open_ if b[0] >= size]
            if fits:
                best = min(b[0] for b in fits)
                b = [b for b in open_ if b[0] == best][-1]
                open_.remove(b)
            else:
                if len(open_) >= limit:
                    least = min(b[0] for b in open_)
                    full = [b for b in open_ if b[0] == least][-1]
                    open_.remove(full)
                    want.append(full[1])
                b = [capacity, []]
            b = [b[0] - size, [*b[1], (i, size)]]
            (want.append(b[1]) if b[0] == 0 else open_.append(b))
        assert closed == want
        rest = packer.close()
        assert sorted(map(tuple, rest)) == sorted(tuple(b[1]) for b in open_)


@pytest.mark.parametrize("n,want", [(0, [(0, 0)]), (10, [(0, 10)]), (11, [(0, 10), (10, 1)]), (30, [(0, 10), (10, 10), (20, 10)])])
def test_pieces(n, want):
    assert P.pieces(n, 10) == want


@needs_vocabulary
def test_texts_are_packed_whole(spark):
    rng = random.Random(7)
    data = [(i, None if i % 50 == 0 else "" if i % 50 == 1 else "star " * rng.randrange(1, 120)) for i in range(600)] + [(601, "sky " * 3000), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*d, 9) for d in data], "doc_id long, text string, position int").repartition(3, "text")
    rows = P.pack_texts(docs, capacity=200, open_bins=8).collect()
    sizes = {}
    for r in T.encode_texts(docs).collect():
        sizes.setdefault(r["doc_id"], []).append(len(r["ids"]))
    total, bins = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["container_id"], []).append(r)
        assert r["n_tokens"] == 200 or r["piece"] == 0 or r["doc_id"] == 601
    assert total == {k: sum(v) for k, v in sizes.items()}
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: (r["position"], r["n_tokens"])):
            assert r["position"] == at
            at += r["n_tokens"]
        assert at <= 200
    used = sum(total.values())
    assert len(bins) <= 1.05 * used / 200 + 1
    assert P.container_summary(P.pack_texts(docs, capacity=200)).first()["tokens"] == used
    assert P.pack_texts(docs.limit(0)).count() == 0
