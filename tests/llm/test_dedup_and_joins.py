import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelgate.llm import exact_dedup as dedup
from voxelgate.llm import ngram_join, sharding
from voxelgate.llm.components import connected_components
from voxelgate.llm.exact_dedup import exact_dedup, normalise, radix_groups
from voxelgate.llm.ngram_join import near_groups, shingle_sets
from voxelgate.llm.top_k import exact_top_k

# extra columns have names that the operators use themselves
DOCS = "doc_id long, text string, row string, keep_id int, prefix string, id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "x", 2) for i, t in rows], DOCS)


ODD = [(5, "a  b"), (3, "a b"), (4, "a\tb"), (9, None), (8, ""), (2, " "), (1, "x" * 70_000), (0, "x" * 70_000), (7, "x" * 70_000 + "y"), (6, "a b"), (3, "a b"), (None, "a b"), (None, "z"), (10, "ä b"), (11, "Ä b")]


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalise((t or "").encode()), []).append(i)
    out = []
    for i, t in rows:
        n = normalise((t or "").encode())
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), hashlib.sha256(n).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("small", "large"), [(1000, 32 << 20), (2, 32 << 20), (1000, 500)])
def test_exact_dedup(spark, monkeypatch, small, large):
    """With small groups of two, or of few bytes, prefixes become hot and go through salted pieces and deeper levels."""
    monkeypatch.setattr(dedup, "SMALL_GROUP", small)
    monkeypatch.setattr(dedup, "LARGE_BYTES", large)
    rows = ODD + [(100 + i, "common start of many texts " * 4 + str(i % 5)) for i in range(60)]
    got = exact_dedup(docs(spark, rows)).collect()
    assert sorted([(r.row.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_dedup(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.row.doc_id == r.keep_id for r in kept)


def test_exact_dedup_carries_rows_and_takes_no_rows(spark):
    given = docs(spark, ODD)
    kept = exact_dedup(given, carry=given.columns).filter("kept").select("row.*")
    assert kept.columns == given.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 2, 3, 7, 8, 10, 11]
    assert exact_dedup(given.limit(0)).count() == 0


def test_radix_groups():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice((0, 1, 7, 8, 9, 40, 41)))).encode() for _ in range(300)]
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert sorted(sorted(g) for g in radix_groups(texts)) == sorted(want.values()) and list(radix_groups([])) == []


def brute_near(rows, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j] and sets[i] == sets[j]:
                root[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None)
        out.append((k, len(sets[i]), low if k is not None else None))
    return sorted(out, key=str)


def near_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, "  "), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"), (1006, "one two"), (None, "one two"), (1007, "long " * 30_000), (1008, "Long " * 29_000)]
    for k in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for c in range(12):
            text = list(base)
            for _ in range(c // 2):
                text[rng.randrange(60)] = rng.choice(words)
            rows.append((10 * k + 100 * c, " ".join(text)))
    passage = [rng.choice(words) for _ in range(40)]
    rows += [(5000 + i, " ".join([*passage, *[rng.choice(words) for _ in range(rng.randrange(1, 20))]])) for i in range(30)]
    rows += [(6000 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    return rows


@pytest.mark.parametrize("limit", [300_000, 0])
def test_near_groups(spark, monkeypatch, limit):
    """Without ids to broadcast, the sets come by a shuffle."""
    monkeypatch.setattr(ngram_join, "_BROADCAST_IDS", limit)
    monkeypatch.setattr(ngram_join, "_BYTES_A_FRAGMENT", 20_000)
    rows = near_rows()
    got = near_groups(docs(spark, rows)).collect()
    want = brute_near(rows)
    assert sorted([tuple(r) for r in got], key=str) == want and len({w[2] for w in want}) < len(rows) - 20


@pytest.mark.parametrize("tile", [512, 7])
def test_links_are_counted(spark, monkeypatch, tile):
    """With small tiles, classes have several of them."""
    monkeypatch.setattr(ngram_join, "_TILE_SETS", tile)
    monkeypatch.setattr(ngram_join, "_COLUMNS", 64 * tile)
    rng = random.Random(15)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join("new" + str(i) if k == i % 60 else w for k, w in enumerate(base))) for i in range(40)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(7)] + [(200 + i, " ".join(rng.choice(base) for _ in range(50))) for i in range(5)]
    rows += [(300, "one two"), (301, "One  two"), (302, None), (303, "")]
    grams = {}
    for i, t in rows:
        w = (t or "").lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = {i: sum(near(g, h) for k, h in grams.items() if k != i) for i, g in grams.items()}
    got = near_groups(docs(spark, rows), links=True).collect()
    assert {r.id: r.links for r in got} == want and max(want.values()) > 30 and len(got) == len(rows)
    assert {(r.id, r.component) for r in got} == {(r.id, r.component) for r in near_groups(docs(spark, rows)).collect()}
    assert [tuple(r) for r in near_groups(docs(spark, [(1, None)]), links=True).collect()] == [(1, 0, 1, 0)]


def test_near_groups_without_rows(spark):
    assert near_groups(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in near_groups(docs(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_shingles_are_sets_of_words():
    a, b, c, d, e = shingle_sets(pa.array(["A b\tc d e f a b c d e", "a B c d e f", " a b ", None, "é b c d E"]))
    assert len(a) == 6 and set(b) < set(a) and len(c) == 1 and len(d) == 0 and len(e) == 1


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    assert got == {x: find(x) for x in root}


def test_sharding(spark):
    rng = random.Random(4)
    rows = [(i, "t" * rng.randrange(0, 300) + str(i)) for i in range(400)] + [(1000 + i, "same") for i in range(200)] + [(2000, None), (2001, ""), (None, "n"), (None, "n")] + [(3000, "g" * 20_000)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    slots, sizes, shard_of = {}, {}, {}
    text = dict((i, t or "") for i, t in rows)
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert r["size"] == len(text[r.id]) + 1 and shard_of.setdefault(text[r.id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    giant = sizes.pop(shard_of["g" * 20_000])
    assert giant == 20_001 and max(sizes.values()) - min(sizes.values()) <= 2 * 1000
    assert sharding.shard_documents(docs(spark, rows).limit(0)).count() == 0
    few = sharding.shard_documents(docs(spark, [(1, "a"), (2, "a"), (3, "b")])).collect()
    assert len(few) == 3 and len({r.shard for r in few if r.id in (1, 2)}) == 1


def minimax(sizes, k):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= k

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("seed", range(100))
def test_minimax_cuts(seed):
    rng = random.Random(seed)
    # every other case has a heavy tail
    sizes = [rng.choice((1, 2, rng.randrange(1, 60))) if seed % 2 else int(rng.paretovariate(0.8)) % 2000 + 1 for _ in range(rng.randrange(1, 300))]
    prefix = np.cumsum(sizes).tolist()
    width = rng.choice((1, 9, 70))
    cells = [(prefix[i], prefix[min(len(prefix), i + width) - 1]) for i in range(0, len(prefix), width)]

    def refine(asked):
        out = {}
        for a, b in asked:
            for h in prefix:
                if a <= h <= b:
                    out.setdefault((a, (h - a) // max(1, -(-(b - a) // 4))), []).append(h)
        return [(min(x), max(x)) for x in out.values()]

    k = rng.randrange(1, 9)
    ends = sharding.minimax_cuts(prefix[-1], max(sizes), k, sharding.PrefixBounds(cells), refine)
    assert max(b - a for a, b in zip([0, *ends], ends, strict=False)) == minimax(sizes, k) and ends[-1] == prefix[-1]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200}, {"block_bytes": 100, "group_bytes": 200}, {"block_bytes": 100, "group_bytes": 100, "place_bytes": 500}, {"place_bytes": 700}])
def test_top_k(spark, sizes):
    """With small sizes, queries and candidates go over grids of several rows, of several columns, of more rows than shuffle partitions, and rows have several blocks."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(300)] + [(i, [1.0] * 6) for i in range(300, 360)]
    rows += [(400, None), (450, [float("nan")] * 6), (451, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [9.0] * 6), (500, [1e200] * 6), (501, [-1e200] * 6), (50, rows[50][1]), (600, [1.0, 2.0]), (601, [2.0, 1.0])]
    got = exact_top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5), F.col("vec_id") % 50 == 0, **sizes).collect()
    sound = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v)}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = []
    for q, a in sound.items():
        if q % 50 == 0:
            best = sorted((-clip(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in sound.items() if i != q and len(a) == len(b))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_broadcasts_no_copies(spark, monkeypatch, tmp_path):
    """Queries that are few before they are copied for each place of the grid don't pass the driver."""
    from voxelgate.llm import top_k

    rng, plans, real = np.random.default_rng(3), [], top_k.checkpoint

    def spy(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(top_k, "checkpoint", spy)
    vectors = rng.normal(0, 1, (3000, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/v")
    got = exact_top_k(spark.read.parquet(f"{tmp_path}/v"), F.col("vec_id") % 50 == 0).collect()
    assert plans and not any("Broadcast" in p for p in plans)
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 3000, 50):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == want
