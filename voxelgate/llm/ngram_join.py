"""Similarity join on n-gram sets by vertical partitioning of the global n-gram order.

The order is cut into fragments, overlaps are counted in each fragment on its own, and the counts
are summed. It is done twice:

* over hashes: each fragment counts, for each set, how many of its n-grams other sets have too. A
  set can only be similar to another if the sum over the fragments reaches the threshold, which
  few sets do. Tasks merge what they hold of an n-gram before they send it, so a fragment gets a
  common n-gram once from each batch of documents.
* over the n-grams of the sets that remain, ordered by frequency: candidates share one of their
  rarest n-grams at places that leave enough room; each fragment counts the overlap of each
  candidate pair, and the sums decide.

For the classes of linked documents pairs are first formed with one set of each list only; what
that leaves apart is then compared with everything in other classes, so large groups of near copies
don't become all of their pairs, and no link between classes is lost. All links lie within classes,
where they are counted tile by tile: the sets of a class are packed into tiles by size, and for two
tiles at a time the overlaps of all their sets are sums, over fragments of the n-grams, of matrix
products. Only counts leave a task; equal sets count by number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, clear_shuffles, shuffle_partitions, slices, tidy
from .components import connected_components
from .words import distinct_words

_BATCH_DOCS, _BATCH_BYTES = 1000, 4 << 20
#: Fragments whose counts are summed in one task, and the share of all rows from which a set's rows are named without a join on their digest.
_FRAGMENTS_A_SUM, _HOT_SHARE = 8, 1024
_BITS = 512
#: Of so many lists each set is compared with one other set first.
_STAR_LISTS = 6
_BYTES_A_FRAGMENT = 10 << 20
#: Sets and n-grams of a tile, and n-grams of a fragment whose products are computed at once.
_TILE_SETS, _TILE_GRAMS, _COLUMNS = 512, 1 << 18, 4096
#: A broadcast of so many ids takes a few MB; beyond it the ids are joined by a shuffle.
_BROADCAST_IDS = 300_000
#: Ends of the fragments of the frequency order: n-grams in at most so many sets.
_FREQUENCY_ENDS = (3,)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct word n-grams; with fewer words than size, of the whole sequence."""
    codes, begins, words = distinct_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if "" in words:
        kept = codes != words.index("")
        begins = np.concatenate([[0], np.cumsum(kept)])[begins]
        codes = codes[kept]
    w = hashes[codes]
    grams = _gram_hashes(w, size)
    none = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - size + 1]) if b - a >= size else _gram_hashes(w[a:b], b - a) if b > a else none)
    return out


def _gram_hashes(words: np.ndarray, span: int) -> np.ndarray:
    count = max(0, len(words) - span + 1)
    h = np.full(count, span, np.uint64) * _ODD[-1]
    for i in range(span):
        h += words[i : i + count] * (_ODD[i % len(_ODD)] + np.uint64(2 * (i // len(_ODD))))
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    return h


def _parities(grams: np.ndarray) -> list[int]:
    """_BITS bits, each whether an odd number of the n-grams falls on it. Two sets differ in at least as many n-grams as these differ in bits."""
    odd = np.bincount((grams & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _deal(fragments: int, size: int):
    """Documents to one row for each batch and fragment: the low hash bits set by set, and whose they are."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in batches:
            for batch in slices(whole, whole.column("text"), _BATCH_DOCS, _BATCH_BYTES):
                ids = batch.column("id")
                sets = shingle_sets(batch.column("text"), size)
                digests = [_digest(x) for x in sets]
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                classes: dict[bytes, int] = {}
                first = []
                which = np.full(len(sets), -1, np.int32)
                for i, (grams, digest) in enumerate(zip(sets, digests, strict=True)):
                    if len(grams) and known[i]:
                        which[i] = classes.setdefault(digest, len(classes))
                        if which[i] == len(first):
                            first.append(grams)
                n = len(first)
                grams = np.concatenate([*first, np.zeros(0, np.uint64)])
                owner = np.repeat(np.arange(n), [len(x) for x in first])
                order = np.argsort(grams, kind="stable")
                grams, owner = grams[order], owner[order]
                begin = np.ones(len(grams), bool)
                begin[1:] = grams[1:] != grams[:-1]
                group = np.cumsum(begin) - 1
                shared = np.bincount(group, minlength=1) > 1 if len(grams) else np.zeros(0, bool)
                mine = shared[group]
                here = np.bincount(owner[mine], minlength=n)
                # what several sets of the batch have is sent once, as that of no set
                grams = np.concatenate([grams[~mine], grams[begin][shared]])
                owner = np.concatenate([owner[~mine], np.full(int(shared.sum()), n)])
                place = ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
                key = place.astype(np.int64) * (n + 1) + owner
                order = np.argsort(key, kind="stable")
                low = (grams[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                found, counts = np.unique(key[order], return_counts=True)
                short = np.array([int.from_bytes(x[:8], "little") for x in classes] + [0], np.uint64)
                # only the fragments that the batch has something of
                met = np.unique(found // (n + 1))
                edges = np.searchsorted(found, np.concatenate([met, [fragments]]) * (n + 1))
                sums = np.concatenate([[0], np.cumsum(counts)])
                rows = {"fragment": [], "batch": [], "low": [], "owner": [], "count": [], "digest": [], "head": []}
                for f, a, b in zip(met.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own = found[a:b] - f * (n + 1)
                    for k, v in (("fragment", f), ("batch", number), ("low", low[sums[a] : sums[b]].tobytes()), ("owner", np.where(own == n, -1, own).astype(np.int32).tobytes()), ("count", counts[a:b].astype(np.int32).tobytes()), ("digest", short[own].tobytes()), ("head", None)):
                        rows[k].append(v)
                head = {"id": ids.to_pylist(), "n": [len(x) for x in sets], "digest": digests, "class": which.tolist(), "here": here.tolist()}
                for k, v in (("fragment", number % fragments), ("batch", number), ("low", None), ("owner", None), ("count", None), ("digest", None), ("head", head)):
                    rows[k].append(v)
                number += 1
                yield pa.RecordBatch.from_pydict(rows, schema=_DEALT)

    return deal


_HEAD = pa.struct([("id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("digest", pa.list_(pa.binary())), ("class", pa.list_(pa.int32())), ("here", pa.list_(pa.int64()))])
_HEAD_SQL = "head struct<id:array<long>,n:array<long>,digest:array<binary>,class:array<int>,here:array<long>>"
_DEALT = pa.schema([("fragment", pa.int32()), ("batch", pa.int64()), ("low", pa.binary()), ("owner", pa.binary()), ("count", pa.binary()), ("digest", pa.binary()), ("head", _HEAD)])


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each fragment: for each batch and set, how many n-grams other sets have too."""
    schema = pa.schema([("batch", pa.int64()), ("owner", pa.binary()), ("count", pa.binary()), ("head", _HEAD)])
    by_fragment: dict[int, list[tuple]] = {}
    for batch in batches:
        heads = [i for i, x in enumerate(batch.column("head").is_valid().to_pylist()) if x]
        if heads:
            part = batch.take(pa.array(heads))
            none = pa.nulls(len(heads), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("batch"), none, none, part.column("head")], schema=schema)
        columns = [batch.column(c).to_pylist() for c in ("fragment", "batch", "low", "owner", "count", "digest")]
        for f, *rest in zip(*columns, strict=True):
            if rest[1] is not None:
                by_fragment.setdefault(f, []).append(rest)
    while by_fragment:
        _, rows = by_fragment.popitem()
        low = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        owners = [np.frombuffer(r[2], np.int32) for r in rows]
        counts = [np.frombuffer(r[3], np.int32) for r in rows]
        digests = np.concatenate([np.frombuffer(r[4], np.uint64) for r in rows])
        every, owner = np.concatenate(counts), np.concatenate(owners)
        slot = np.repeat(np.arange(len(every), dtype=np.int32), every)
        order = np.argsort(low, kind="stable")
        low, slot = low[order], slot[order]
        begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        digest = digests[slot]
        differs = (digest != np.repeat(digest[begin], np.diff(np.r_[begin, len(low)]))) | (owner[slot] < 0)
        shared = np.repeat(np.logical_or.reduceat(differs, begin), np.diff(np.r_[begin, len(low)]))
        found = np.bincount(slot[shared], minlength=len(every))
        at, out = 0, {"batch": [], "owner": [], "count": [], "head": []}
        for r, own in zip(rows, owners, strict=True):
            mine = found[at : at + len(own)]
            at += len(own)
            kept = (own >= 0) & (mine > 0)
            if kept.any():
                for k, v in (("batch", r[0]), ("owner", own[kept].tobytes()), ("count", mine[kept].astype(np.int32).tobytes()), ("head", None)):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _sum_shared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, sums = {}, {}
        for batch in batches:
            for number, owner, count, head in zip(*(batch.column(c).to_pylist() for c in ("batch", "owner", "count", "head")), strict=True):
                if head is not None:
                    heads[number] = head
                else:
                    sums.setdefault(number, []).append((np.frombuffer(owner, np.int32), np.frombuffer(count, np.int32)))
        for number, head in heads.items():
            total = np.array([*head["here"], 0], np.int64)
            for owner, count in sums.get(number, ()):
                total[owner] += count
            n, which = np.array(head["n"], np.int64), np.array(head["class"], np.int64)
            alive = (which >= 0) & (100 * total[which] >= percent * n)
            yield pa.RecordBatch.from_arrays([pa.array(head["id"], pa.int64()), pa.array(n), pa.array(head["digest"], pa.binary()), pa.array(alive)], ["id", "n", "digest", "alive"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column("text"), _BATCH_DOCS):
                found = list(zip(shingle_sets(batch.column("text"), size), batch.column("digest").to_pylist(), strict=True))
                keep = [i for i, (grams, digest) in enumerate(found) if _digest(grams) == digest]
                lists = [found[i][0] for i in keep]
                part = batch.take(pa.array(keep, pa.int64()))
                grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("rep"), grams, pa.array([_parities(x) for x in lists], pa.list_(pa.int64()))], ["digest", "rep", "grams", "bits"])

    return run


def _overlaps(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb) those that are similar: overlaps of the fragments, summed up."""
    left = pairs.join(parts.select(F.col("c").alias("a"), "fragment", F.col("grams").alias("ga")), "a")
    both = left.join(parts.select(F.col("c").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("overlap")).groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return counted.filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _sizes_fit(percent: int):
    """Whether sizes and parities leave room for the overlap that similarity needs."""
    na, nb = F.col("na"), F.col("nb")
    differ = sum((F.bit_count(F.col(f"xa{i}").bitwiseXOR(F.col(f"xb{i}"))) for i in range(_BITS // 64)), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * (na + nb - differ) >= 2 * percent * (na + nb))


def _places_fit(percent: int):
    """Whether the places of a common n-gram leave room for it, if none before is common."""
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, links: bool = False) -> DataFrame:
    """For each row of docs: id, n (distinct n-grams), component (smallest id reachable by links) and, if asked for, links (how many other rows it is linked with).

    Two rows are linked when 100 * overlap >= percent * union of their sets of n-grams of size
    words (lower-case A-Z, separated by blanks). A text with fewer words is one n-gram; a null or
    blank text has none and no links, and its component is its id. Rows with a null id have no
    links and a null component. Repeated rows are linked with each other; rows that repeat an id
    share that node. Very long texts are taken whole. An empty table gives no rows. docs has to
    give the same rows in the same order if a lost task reads it again, as files and checkpoints do.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(spark.sparkContext.defaultParallelism, -(-total // _BYTES_A_FRAGMENT))
    dealt = given.mapInArrow(tidy(_deal(fragments, size)), f"fragment int, batch long, low binary, owner binary, count binary, digest binary, {_HEAD_SQL}")
    shared = dealt.repartition(fragments, "fragment").mapInArrow(tidy(_count_shared), f"batch long, owner binary, count binary, {_HEAD_SQL}")
    sums = max(shuffle_partitions(spark), -(-fragments // _FRAGMENTS_A_SUM))
    rows = checkpoint(shared.repartition(sums, "batch").mapInArrow(tidy(_sum_shared(percent)), "id long, n long, digest binary, alive boolean"))
    # nothing refers to their shuffles any more, and the rest needs the disk
    del dealt, shared
    clear_shuffles(spark)
    classes = rows.filter("id IS NOT NULL AND n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"), F.max("alive").alias("alive"))
    classes = checkpoint(classes.filter("alive OR members > 1"))
    wanted = classes.filter("alive").select(F.col("rep").alias("id"), "digest", "rep")
    if wanted.count() <= _BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = given.join(wanted, "id").mapInArrow(tidy(_sets(size)), "digest binary, rep long, grams array<long>, bits array<long>")
    # repeated rows give a set twice
    sets = checkpoint(texts.groupBy("digest").agg(F.first("rep").alias("rep"), F.first("grams").alias("grams"), F.first("bits").alias("bits")))
    del texts, wanted
    clear_shuffles(spark)
    sets = sets.select(F.monotonically_increasing_id().alias("c"), "digest", "rep", F.size("grams").cast("long").alias("n"), "grams", "bits")
    labels = _classes(sets.select("c", "n", "grams", "bits"), percent)
    labels = checkpoint(labels) if links else labels
    named = sets.select("c", "digest", "rep").join(labels.withColumnRenamed("node", "c"), "c")
    lowest = named.groupBy("component").agg(F.min("rep").alias("lowest"))
    linked = named.join(lowest, "component").select("digest", "lowest")
    final = classes.join(linked, "digest", "left").select("digest", "members", F.least("rep", "lowest").alias("component"))
    is_node = (F.col("n") > 0) & F.col("id").isNotNull()
    columns = ["id", "n", F.when(is_node, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component")]
    if links:
        final = final.join(_others(sets, labels, classes.select("digest", "members"), percent), "digest", "left")
        columns.append(F.when(is_node, F.coalesce(F.col("members") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("links"))
    # sets of so many rows are few, and are named by a broadcast; rows without a set need no name
    final = checkpoint(final)
    limit = max(1, rows.count() // _HOT_SHARE)
    none = F.lit(None)
    hot = final.filter(F.col("members") > limit).select("digest", F.struct(*[c for c in final.columns if c != "digest"]).alias("hot"))
    marked = rows.join(F.broadcast(hot), "digest", "left")
    known = marked.filter(is_node & F.col("hot").isNotNull()).select("id", "n", "hot.*")
    bare = marked.filter(~is_node).select("id", "n", *[none.cast(final.schema[c].dataType).alias(c) for c in final.columns if c != "digest"])
    rest = marked.filter(is_node & F.col("hot").isNull()).drop("hot").join(final.filter(F.col("members") <= limit), "digest", "left").select(known.columns)
    return known.unionByName(bare).unionByName(rest).select(*columns)


def _others(sets: DataFrame, labels: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Rows (digest, others): how many rows have another set that is linked with this one, which then is of the same class."""
    # linked sets have sizes of the same band or of neighbouring ones
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")
    placed = sets.select("c", "digest", "n", "grams").join(labels.select(F.col("node").alias("c"), "component"), "c").join(members, "digest").withColumn("band", band)
    dealt = placed.groupBy("component", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / _TILE_SETS), F.ceil(F.sum("n") / _TILE_GRAMS)).alias("tiles"))
    tile = F.pmod(F.xxhash64("c"), F.col("tiles"))
    item = F.struct("c", "digest", "members", "n", "grams")
    tiles = placed.join(dealt, ["component", "band"]).groupBy("component", "band", tile.alias("tile")).agg(F.collect_list(item).alias("t"))
    tiles = tiles.select("component", "band", "tile", F.col("t.c").alias("c"), F.col("t.digest").alias("digest"), F.col("t.members").alias("members"), F.col("t.n").alias("n"), F.flatten("t.grams").alias("grams"))
    tiles = checkpoint(tiles)
    fields = ("c", "digest", "members", "n", "grams")
    left = tiles.select("component", "band", F.col("tile").alias("i"), *[F.col(x).alias(f"{x}_a") for x in fields])
    right = tiles.select("component", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("own"), F.col("tile").alias("j"), *[F.col(x).alias(f"{x}_b") for x in fields])
    pairs = left.join(right, ["component", "band"]).filter((F.col("own") > F.col("band")) | (F.col("i") <= F.col("j")))
    counted = pairs.select(((F.col("own") == F.col("band")) & (F.col("i") == F.col("j"))).alias("same"), *[f"{x}_{s}" for s in "ab" for x in fields if x != "c"]).mapInArrow(tidy(_count_links(percent)), "digest binary, others long")
    return counted.groupBy("digest").agg(F.sum("others").alias("others"))


def _products(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: int) -> np.ndarray:
    """Overlaps of the sets of two tiles, given as all their n-grams one after another and their sizes; n-grams in fewer than least places don't count."""
    values, place, counts = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
    rows_a, rows_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    kept = np.cumsum(counts >= least) - 1
    fragment, column = np.divmod(np.where(counts >= least, kept, -1), _COLUMNS)
    total = np.zeros((len(na), len(nb)), np.float32)
    for f in range(-(-int(kept[-1] + 1) // _COLUMNS) if len(values) else 0):
        sides = []
        for rows, at, n in ((rows_a, place[: len(a)], len(na)), (rows_b, place[len(a) :], len(nb))):
            mine = fragment[at] == f
            side = np.zeros((n, _COLUMNS), np.float32)
            side[rows[mine], column[at[mine]]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def _count_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                flat = lambda c: r[c].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                na, nb = flat("n_a"), flat("n_b")
                # within one tile every n-gram comes twice
                overlap = _products(flat("grams_a"), na, flat("grams_b"), nb, 4 if r["same"].as_py() else 2)
                linked = 100 * overlap >= percent * (na[:, None] + nb[None, :] - overlap)
                if r["same"].as_py():
                    np.fill_diagonal(linked, False)
                    yield _counts(r["digest_a"], linked @ flat("members_b"))
                else:
                    yield _counts(r["digest_a"], linked @ flat("members_b"))
                    yield _counts(r["digest_b"], flat("members_a") @ linked)

    return run


def _counts(digests: pa.ListScalar, others: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(others)
    return pa.RecordBatch.from_arrays([digests.values.take(pa.array(some)), pa.array(others[some].astype(np.int64))], ["digest", "others"])


def _lists(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of sets (c, n, grams, bits) the n-grams of the prefixes with their places, and the n-grams of each fragment."""
    grams = sets.select("c", "n", F.explode("grams").alias("g"))
    frequent = grams.groupBy("g").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    placed = grams.join(frequent, "g").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("order"))
    placed = checkpoint(placed)
    clear_shuffles(sets.sparkSession)
    band = sum(((F.col("x.f") > e).cast("int") for e in _FREQUENCY_ENDS), F.lit(0))
    parts = placed.select("c", F.explode("order").alias("x")).groupBy("c", band.alias("fragment")).agg(F.collect_list("x.g").alias("grams"))
    parts = checkpoint(parts)
    clear_shuffles(sets.sparkSession)
    # n-grams of one set alone come first in the order and have no list
    alone = F.col("n") - F.size("order")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - alone
    lists = placed.filter(prefix > 0).select("c", "n", alone.alias("alone"), F.least(prefix, F.size("order")).alias("many"), F.posexplode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("at", "x"))
    parities = [F.col("bits")[i].alias(f"x{i}") for i in range(_BITS // 64)]
    return checkpoint(lists.select(F.col("x.g").alias("g"), "c", "n", (F.col("at") + _STAR_LISTS >= F.col("many")).alias("late"), (F.col("alone") + F.col("at")).alias("p")).join(sets.select("c", *parities), "c")), parts


_FIELDS = ["c", "n", "p", *[f"x{i}" for i in range(_BITS // 64)]]


def _side(name: str) -> list:
    """The fields of a list as those of one side of a pair."""
    return [F.col("c").alias(name), *[F.col(x).alias(f"{x[0]}{name}{x[1:]}") for x in _FIELDS[1:]]]


def _classes(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, component) of the linked ones of sets (c, n, grams, bits)."""
    lists, parts = _lists(sets, percent)
    left, right = _side("a"), _side("b")
    # one set of each list, drawn anew for each n-gram, is compared with those that have the n-gram at the end of their prefix, where lists are longest
    centres = lists.groupBy("g").agg(F.min(F.struct(F.xxhash64("c", "g").alias("draw"), *_FIELDS)).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    centres = centres.select("g", "m.*").select("g", *right)
    stars = lists.filter("late").select("g", *left).join(centres, "g").filter(F.col("a") != F.col("b")).filter(_sizes_fit(percent))
    first = F.col("a") < F.col("b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
    labels = connected_components(_overlaps(stars, parts, percent)).withColumnRenamed("node", "c")
    known = checkpoint(lists.join(labels, "c", "left").withColumn("component", F.coalesce("component", "c")))
    # in each list, all of the component that has most of it is one side only
    by_part = known.groupBy("g", "component").agg(F.count(F.lit(1)).alias("k"))
    main = by_part.groupBy("g").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("g", F.col("m.component").alias("main"))
    apart = known.join(main, "g")
    one = apart.filter("component <> main").select("g", *left, F.col("component").alias("ca"))
    other = apart.select("g", *right, F.col("component").alias("cb"), (F.col("component") == F.col("main")).alias("is_main"))
    rest = one.join(other, (one["g"] == other["g"]) & (F.col("ca") != F.col("cb")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & _sizes_fit(percent) & _places_fit(percent)).select("a", "b", "na", "nb").distinct()
    # the links that join classes are all that matters of them
    joins = checkpoint(_overlaps(rest, parts, percent))
    for side in "ab":
        joins = joins.join(labels.select(F.col("c").alias(side), F.col("component").alias(f"r{side}")), side, "left").withColumn(side, F.coalesce(f"r{side}", side))
    later = connected_components(joins.filter("a <> b").select("a", "b"))
    if labels.isEmpty():
        return later
    both = labels.withColumnRenamed("c", "node").join(later.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    return both.unionByName(later.join(both.select("node"), "node", "left_anti"))
