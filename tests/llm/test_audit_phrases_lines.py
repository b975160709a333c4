"""Filter audit, collocations and repeated lines against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from voxelgate.llm import collocations as co
from voxelgate.llm.filter_audit import flag_documents, replay
from voxelgate.llm.line_dedup import drop_repeated_lines

DOC = "doc_id long, text string, lang string, source string, `row` string, id string, h1 string, part string"


def docs_of(spark, rows, parts=3):
    """rows: doc_id, text, lang, source; extra columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOC).repartition(parts)


# lines


def lines_by_hand(rows, least=3, length=20):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: -1 if i is None else i
    holders = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= length:
                holders[k].append((n, rank(i)))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= length and len(holders[key(x)]) >= least and rank(i) != max(r for _, r in holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["short", "", "   ", "This Line is long enough to be dropped", "\tthis line is LONG enough to be dropped\r", "ÉTAT de l'art, une ligne assez longue", "état de l'art, une ligne assez longue", "exactly twenty chars", "exactly nineteen ch", "twice in the same text, and nowhere else"]
    rows = [(i, "\n".join(rng.choice(pool[:9]) for _ in range(rng.randrange(0, 8))), None, None) for i in range(40)]
    rows += [(50, pool[9] + "\n" + pool[9], None, None), (51, pool[9], None, None), (52, None, None, None), (None, pool[3] + "\nmine", None, None), (None, pool[3], None, None)]
    rows += [(60, pool[3] + "\n" + pool[7], None, None)] * 2 + [(60, "another text of id sixty\n" + pool[3], None, None)]
    rows += [(70, "\n".join([pool[7]] + [f"a line of its own, number {i}" for i in range(30_000)]), None, None)]
    got = drop_repeated_lines(docs_of(spark, rows)).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r["row"].doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == order(lines_by_hand(rows))


def test_lines_that_only_rows_without_an_id_have_stay(spark):
    rows = [(None, f"a line that is everywhere the same\n{i}", None, None) for i in range(4)]
    assert {r.n_dropped for r in drop_repeated_lines(docs_of(spark, rows)).collect()} == {0}
    assert drop_repeated_lines(docs_of(spark, rows).limit(0)).count() == 0


def test_lines_with_other_limits(spark):
    rows = [(i, "abc\nd", None, None) for i in range(2)]
    got = {r["row"].doc_id: r.kept_text for r in drop_repeated_lines(docs_of(spark, rows), min_length=3, min_docs=2).collect()}
    assert got == {0: "d", 1: "abc\nd"}


# audit


def failures(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, _, s in rows:
        t = t or ""
        words = [w for w in re.split("[\\x20\\x09-\\x0D]+", t) if w]
        caps = sum("A" <= c <= "Z" for c in t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * caps > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and first[t] < i]
        yield s or "", i, {x for x, f in zip("ABCDE", fails, strict=True) if f}


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[n] == 1} for n in (0, 1))
    found = list(failures(rows))
    out = Counter()
    keys = {(p, "".join(o), s) for p, _, _ in found for o in permutations("ABCDE") for s in range(1, 6)}
    shapley = Counter()
    for part, i, fails in found:
        for o in permutations("ABCDE"):
            gone = None
            for s, f in enumerate(o, 1):
                k = (part, "".join(o), s)
                out[k, "unique_fails"] += fails == {f}
                if f in fails and gone:
                    out[k, "redundant"] += 1
                elif f in fails:
                    gone = s
                    out[k, "removed"] += 1
                    out[k, "good_lost"] += i in good
                    out[k, "toxic_lost"] += i in toxic
                    shapley[part, f] += 1
                out[k, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: (*[out[k, n] for n in names], shapley[k[0], k[1][k[2] - 1]]) for k in keys}


def test_audit_against_brute_force(spark):
    rng = random.Random(11)
    words = ["plain", "Words", "of", "a", "text", "that\tgoes", "on\n", "ÉTÉ", "$", "AB"]
    rows = []
    for i in range(30):
        vocabulary = words if i % 3 else [f"w{j}" for j in range(90)]
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 49, 50, 80]))), None, rng.choice(["s1", "s2", None, ""])))
    rows += [(40 + i, rows[i][1], None, "s1") for i in range(12)] + [(60, None, None, "s3"), (61, "", None, "s3"), (None, rows[0][1], None, "s1"), (None, None, None, None), (3, rows[3][1], None, "s2")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 50, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = replay(flag_documents(docs_of(spark, rows), table)).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == audit_by_hand(rows, labels)
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in got)
    # what all filters remove together is shared out whole, 120 times
    for part in {r.part for r in got}:
        mine = [r for r in got if r.part == part]
        (left,) = {r.kept for r in mine if r.step == 5}
        gone = sum(p == part for p, _, _ in failures(rows)) - left
        assert len(mine) == 600 and sum({r["filter"]: r.shapley for r in mine}.values()) == 120 * gone


def test_audit_of_empty_tables(spark):
    empty = docs_of(spark, [(1, "x", None, None)]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert replay(flag_documents(empty, labels)).count() == 0
    assert {r.good_lost for r in replay(flag_documents(docs_of(spark, [(1, "x", None, None)]), labels)).collect()} == {0}


def test_audit_of_other_filters(spark):
    flags = spark.createDataFrame([("p", 3, False, False), ("p", 0, True, False)], "part string, failed int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in replay(flags, "XY").collect()}
    assert got == {("XY", 1): (1, 1, 0), ("XY", 2): (1, 0, 1), ("YX", 1): (1, 1, 0), ("YX", 2): (1, 0, 1)}
    with pytest.raises(ValueError):
        replay(flags, "ABCDEFGH")


# phrases


def phrases_by_hand(rows, least, top, percent=100):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(end, "\n")
        for piece in t.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        rows_ = []
        for p, a in found.items():
            if 100 * inner[p] >= percent * a:
                continue
            cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            k = cut[1]
            rows_.append((-cut[0], -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def sample_texts(seed, count):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = rng.choice(["en", "fr", None, "und"])
        words = ["the", "The", "of", "New", "york", "CITY", "hall", "a\x85b", "é", "ÉE", "x\x1fy", "\t", "  ", ". ", ",", "\n", "\r", "new york city hall"]
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))), lang, None))
    return [*rows, (900, None, "en", None), (901, "", None, None), (901, "only. one? word! a. time", "de", None), (None, " ".join(["aa"] * 4000), "aa", None), (902, "the of " * 60_000, "long", None)]


@pytest.mark.parametrize(("least", "top", "percent", "settings"), [(5, 2000, 100, {}), (3, 7, 90, {"cells": 1 << 16, "rounds": 3, "automaton_bytes": 200}), (300, 2000, 100, {})])
def test_phrases_against_brute_force(spark, least, top, percent, settings):
    rows = sample_texts(least, 120)
    got = co.collocations(docs_of(spark, rows), min_count=least, top=top, inside_percent=percent, **settings).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, least, top, percent)


def test_no_phrases(spark):
    assert co.collocations(docs_of(spark, [(1, "a b", "x", None)]).limit(0)).count() == 0
    assert co.collocations(docs_of(spark, [(1, "a b", "x", None)])).count() == 0
    with pytest.raises(ValueError):
        co.collocations(docs_of(spark, [(1, "a b", "x", None)]), min_count=70_000)


def test_a_small_sketch_only_adds_candidates(spark):
    """With few cells most bounds are far too high; the exact counts decide anyway."""
    rows = [(i, " ".join(f"w{(7 * i + j) % 3000}" for j in range(200)) + ". new york", "x", None) for i in range(60)]
    texts = docs_of(spark, rows).select("lang", "text")
    many, few = (co.candidates(texts, 50, cells=n).count() for n in (1 << 16, 1 << 20))
    assert many >= few >= 3
    assert [r.phrase for r in co.collocations(docs_of(spark, rows), min_count=50, cells=1 << 16).collect()] == ["new york"]


def test_products_beyond_64_bits(spark):
    big = 4_000_000_019
    counts = spark.createDataFrame([("x", "a", big), ("x", "b", big + 2), ("x", "a b", big - 8)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("x", 3 * 10**12 + 1)], "lang string, n long")
    row = co.scored(counts, totals, 100).first()
    assert row.score == 1000 * (big - 8) * (3 * 10**12 + 1) // (big * (big + 2))


def test_sketch_blocks_round_trip():
    """Sums of what tasks send are the counts, in both widths of steps and beyond 255."""
    for least, texts in ((2, ["a b c a b"] * 3), (300, ["q r"] * 400)):
        batch = pa.record_batch({"lang": ["x"] * len(texts), "text": texts})
        sent = list(co._sketcher(1 << 20, 0, 1, least)(iter([batch])))
        (hot,) = list(co._summer(least)(iter(sent)))
        cells = sum(bin(b).count("1") for x in hot.column("bits").to_pylist() for b in bytes(x))
        words = co.Words([t.encode() for t in texts])
        exact = Counter(int(h) for _, _, hs in co._hashes(words, ["x"] * len(texts)) for h in hs)
        assert cells == co.ROWS * sum(n >= least for n in exact.values())


def test_guards():
    automata = co.compile_automata([("x", "a b"), ("x", "b a"), ("x", "b")])
    automaton, known = automata["x"]
    found = Counter(known[i] for _, i in automaton.iter(co.guarded(b"a b a  b\nb ab b")))
    assert found == {"a b": 2, "b a": 1, "b": 4}


@pytest.mark.parametrize("words", [3, 300, 70_000])
def test_word_codes_match_whole_words_only(words):
    """With two digits and with three: matches of codes are those of letters, and no other."""
    rng = random.Random(words)
    known = [f"w{i}" for i in range(words)]
    phrases = [*known, *{" ".join(rng.choice(known[:40]) for _ in range(rng.randrange(2, 6))) for _ in range(300)}]
    texts = [b"\n".join(" ".join(rng.choice([*known[:40], "w", "new", "w1w2"]) for _ in range(rng.randrange(12))).encode() for _ in range(50)) for _ in range(4)]
    codes, read = co.WordCodes(pa.array(phrases)), co.Words(texts)
    coded = codes.coded(codes.places(read.known)[read.codes], read.piece)
    automaton, rows = co.compile_automata([("x", i) for i in range(len(phrases))], codes.phrases())["x"]
    plain, names = co.compile_automata([("x", p) for p in phrases])["x"]
    by_hand = Counter(names[i] for t in texts for _, i in plain.iter(co.guarded(t)))
    assert codes.digits == (3 if words > 65_536 else 2)
    assert Counter(phrases[rows[i]] for _, i in automaton.iter(coded)) == by_hand


def test_phrases_of_six_megabytes_take_one_scan(spark, monkeypatch):
    """Scans of all texts don't grow with every 4 MB of phrases."""
    words = [f"w{i:06d}" for i in range(1000)]
    wanted = spark.createDataFrame([("x", " ".join([a, b])) for a in words[:600] for b in words[:700]], "lang string, phrase string")
    texts = spark.createDataFrame([("x", " ".join(words)), ("x", " ".join(words[:3]))], "lang string, text string")
    packed, scans = co._packed, []
    monkeypatch.setattr(co, "_packed", lambda table: scans.append(len(table)) or packed(table))
    counted = co.count_phrases(texts, wanted)
    assert scans == [420_000]
    assert {(r.phrase, r.f) for r in counted.collect()} == {(f"{a} {b}", 2 if i < 2 else 1) for i, (a, b) in enumerate(zip(words[:600], words[1:601], strict=True))}


def test_sent_phrases_are_remembered():
    """Runs of hashes are merged a few times only, and all of them are found again."""
    rng, sent, seen = np.random.default_rng(3), co._Sent(), set()
    for _ in range(200):
        first = rng.integers(0, 5000, 60).astype(np.uint64)
        assert [int(x) not in seen for x in first] == sent.new(first, first * np.uint64(3)).tolist()
        new = sent.new(first, first * np.uint64(3))
        sent.add(first[new], first[new] * np.uint64(3))
        seen |= {int(x) for x in first}
    assert len(sent) == len(seen) and len(sent.runs) < 14
    assert sent.new(np.array([*seen], np.uint64)[:5], np.zeros(5, np.uint64) + np.uint64(1)).all()


def test_long_texts_are_cut_between_pieces():
    text = b"\n".join(b"w%d x" % i for i in range(1000)) + b"\n" + b"y" * 5000 + b"\nend"
    parts = list(co._cut(text, 300))
    assert b"\n".join(parts) == text and max(map(len, parts)) >= 5000 and len(parts) > 10
    assert list(co._cut(b"", 300)) == [b""]
    assert hashlib.sha256(b"\n".join(co._cut(b"z" * 999, 10))).digest() == hashlib.sha256(b"z" * 999).digest()
