"""Reading levels (p8)."""

import random

from skyloom.llm import reading as R

WORDS = {
    1: "the cat sat on a big red hat and we can see the sun".split(), 2: "astronomers found a giant planet near a nearby star with their new telescope".split(),
    3: "the luminosity scales with the radius because the temperature determines the emitted flux".split(), 4: "heteroscedastic marginalised posterior photometric covariance likelihood kernel degenerate".split(),
}


def text(rng, level, sentences=8):
    return " ".join(" ".join(rng.choice(WORDS[level]) for _ in range(9)).capitalize() + "." for _ in range(sentences))


def tables(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(200):
        level = i % 4 + 1
        docs.append((i, text(rng, level)))
        if i < 120:
            labels += [(i, level, "a"), (i, level, "b"), (i, level, "b"), (i, level % 4 + 1, "c")]
    labels += [(1, None, "d"), (None, 1, "a"), (199, 1, "a"), (199, 2, "b")]
    extra = [(300, None), (301, ""), (302, "Short text."), (303, "1.5 2.5 3.5 4.5\n" * 60), (304, "der Stern liegt weit entfernt und leuchtet sehr schwach am Himmel " * 10), (305, text(rng, 3, 4000)), (306, " \n" * 100), (0, docs[0][1])]
    return (
        spark.createDataFrame([(*d, 1) for d in docs + extra], "doc_id long, text string, level int"),
        spark.createDataFrame(labels, "doc_id long, reading_level int, rater string"),
    )


def test_held_out_levels(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r["reading_level"] for r in R.reading_levels(docs, labels).collect()}
    held = [i for i in range(120, 200)]
    assert sum(got[i] == i % 4 + 1 for i in held) >= 78
    assert not set(got) & {300, 301, 302, 303, 304, 306} and got[305] == 3
    assert R.reading_levels(docs, labels).where("doc_id = 0").count() == 2


def test_majority_leaves_ties_out(spark, rows):
    _, labels = tables(spark)
    got = dict(rows(R.label_majority(labels)))
    assert got[1] == 2 and 199 not in got and len(got) == 120


def test_empty(spark):
    docs, labels = tables(spark)
    assert R.reading_levels(docs.limit(0), labels).count() == 0
    assert R.reading_levels(docs, labels.limit(0)).count() == 0
