"""Personal data in texts whose spans, or near misses of them, are very long: one such text must not end the executor."""

import pytest

from voxelgate.llm import pii

N = 100_000
LONG = {
    "labels": "x@" + "a." * N + "com",
    "labels that end in a digit": "x@" + "a." * N + "c0",
    "dashes": "x@" + "a-" * N + ".com",
    "local part": "a" * N + "@b.com",
    "local dots": "a." * N + "@b.com",
    "at signs": "a@" * N,
    "spelled labels": "x [at] a" + ".aa" * N,
    "spelled dots": "x (at) a" + " [dot] aa" * N,
    "spelled at": "x [at] " * N,
    "parts": "1." * N + "1",
    "long parts": "0" * N + "10.0.0.1",
    "digits": "4" * N,
    "spaced digits": "4 " * N + "4",
    "short digits": "4  " * N,
    "phone": "+1" + "(2 " * N + "3",
    "phone without an end": "+1" + "(" * N,
    "pluses": "+1 " * N,
    "plain phones": "(222) 222 2222 " * N,
    "account": "DE44" + " ABCD" * N,
    "accounts": "DE44 ABCD " * N,
    "secret": "token=" + "a1" * N,
    "secret of marks": "password: '" + "!" * N,
    "secrets": "token=" * N,
    "blanks after a name": "token" + " " * N + "=",
    "numbers": "123-45-" * N,
    "context": "phone " * N + "222 222 2222",
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "doc_id long, text string").repartition(4)


def test_long_spans_are_found(spark, frame):
    found = {list(LONG)[r.row.doc_id]: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.detect(frame, pii.fit(frame)).collect()}
    assert len(found) == len(LONG)
    for name in ("labels", "labels that end in a digit", "dashes", "local part", "local dots"):
        assert ("email", 0, len(LONG[name])) in found[name], name
    assert found["at signs"] == [] and found["phone without an end"] == []
    assert [s for s in found["phone"] if s[0] == "phone"] == []
    assert len(found["plain phones"]) == N


@pytest.mark.parametrize("kind", pii.KINDS)
def test_votes_take_anything_long(spark, frame, kind):
    """Every vote pattern over every text as a span and as its context."""
    from pyspark.sql import functions as F

    votes = F.array(*pii._votes(kind, F.col("text"), F.lower("text")))
    assert all(len(r.v) == 3 for r in frame.select(votes.alias("v")).collect())


def test_long_spans_are_redacted(spark, frame):
    some = frame.filter("doc_id < 4")
    clean = {r.doc_id: r.text for r in pii.redact(some, pii.fit(some)).collect()}
    assert clean[0] == clean[2] == clean[3] == "[EMAIL]"
