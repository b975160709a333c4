"""Quality scores against a plain vote of cosines, and their odd rows."""

import math
import random

import numpy as np
import pytest

from voxelgate.llm import quality

WORDS = ("river", "stone", "market", "winter", "garden", "letter", "window", "silver")
JUNK = ("BUY!!!", "$$$", "click>>", "win#1", "free$$")


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, label int").repartition(3)


def marked(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def fitted(spark, **settings):
    rng = random.Random(31)
    rows = [(i, prose(rng, WORDS if i % 3 else JUNK + WORDS[:2], rng.randrange(5, 60))) for i in range(90)]
    return rows, quality.fit(table(spark, rows), marked(spark, [(i, int(i % 3 > 0)) for i in range(90)]), **settings)


def by_hand(model, text):
    """Cosines one by one; the nearest vote with a power of their cosine."""
    raw = quality.terms(text)
    if not raw.any():
        return model.prior
    place = quality.weighted(raw[None, :], model.rarity)[0].astype(float) @ model.projection.astype(float)
    cosines = []
    for vector, label in zip(model.vectors.astype(float), model.labels, strict=True):
        dot = sum(a * b for a, b in zip(place, vector, strict=True))
        cosines.append((dot / max(math.dist(place, [0] * len(place)), 1e-12), label))
    nearest = sorted(cosines, reverse=True)[: model.neighbours]
    votes = [(max(c, 0.0) ** model.sharpness, label) for c, label in nearest]
    total = sum(v for v, _ in votes)
    return sum(v * label for v, label in votes) / total if total > 1e-12 else model.prior


@pytest.mark.parametrize("block", [1, 7, 256])
def test_scores_are_those_of_a_plain_vote(spark, block):
    rng = random.Random(32)
    _, model = fitted(spark, neighbours=5)
    asked = [(100 + i, prose(rng, WORDS + JUNK, rng.randrange(1, 50))) for i in range(25)]
    asked += [(None, asked[0][1]), (None, None), (200, ""), (201, prose(rng, WORDS, 60_000)), (202, "é"), (100, asked[0][1]), (100, asked[0][1])]
    got = sorted(((r.row.doc_id, r.row.text, r.score) for r in quality.score(table(spark, asked), model, carry=("doc_id", "text"), block=block).collect()), key=repr)
    want = sorted(((i, t, by_hand(model, t)) for i, t in asked), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-3)
    # a repeated text has one score, whatever its id
    assert len({round(s, 6) for _, t, s in got if t == asked[0][1]}) == 1


def test_equal_neighbours_at_the_last_place_share_it(spark):
    same = prose(random.Random(33), WORDS, 30)
    rows = [(i, same) for i in range(4)] + [(4, "BUY!!! $$$ " * 9), (5, "win#1 click>> " * 9)]
    model = quality.fit(table(spark, rows), marked(spark, [(0, 1), (1, 0), (2, 1), (3, 1), (4, 0), (5, 0)]), neighbours=2)
    (r,) = quality.score(table(spark, [(9, same)]), model).collect()
    assert abs(r.score - 0.75) < 1e-6


def test_repeated_rows_and_null_ids_teach_nothing_twice(spark):
    rows, model = fitted(spark)
    again = rows + rows[:40] + [(None, "no id"), (None, None)]
    labels = [(i, int(i % 3 > 0)) for i in range(90)]
    other = quality.fit(table(spark, again), marked(spark, labels + labels[:10] + [(None, 1), (3, None)]))
    assert len(other.labels) == len(model.labels) == 90 and other.prior == pytest.approx(model.prior)
    asked = table(spark, rows[:20])
    both = [{r.row.doc_id: r.score for r in quality.score(asked, m).collect()} for m in (model, other)]
    assert both[0] == pytest.approx(both[1], abs=1e-4)
