"""Phrases whose words stand together more often than chance, by language.

A count-min sketch of all phrases gives an upper bound of each one's count. Phrases whose bound
reaches the least count are candidates; they are compiled into Aho-Corasick automata, which scan the
texts and count all matches, overlapping ones too. Automata and texts have a short code for each word
instead of its letters, so one automaton holds many phrases. The sums are exact counts, and everything
after that is joins and windows over them.

The sketch is never in one place while it is counted: tasks send sorted cells of a block with
their counts, and each block is summed by itself. What is broadcast is one bit for each cell (whose
number is bounded; beyond it the phrases are dealt by hash over more rounds, each with a sketch of
its own) and the phrases of one automaton (bounded by AUTOMATON_BYTES, with as many automata as the
candidates need). So memory is bounded at every size, and a larger corpus takes more scans.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, shuffle_partitions, slices, tidy

LONGEST = 5
#: Cells of a row of the sketch: a power of two, about one for each so many bytes of text, up to the bound (16 MB of bits a row).
BYTES_PER_CELL, FEWEST_CELLS, MOST_CELLS = 64, 1 << 16, 1 << 27
ROWS = 2
#: Cells that are summed together; two bytes tell them apart.
BLOCK = 1 << 16
#: Cells that a task gathers before it sends their counts.
_GATHERED = 1 << 22
#: Phrases of one automaton, in bytes of their letters.
AUTOMATON_BYTES = 20 << 20
#: A code's digits are letters of so many at most, each digit from a range of its own; what is in no phrase is a blank.
_DIGITS, _BLANK = 256, 0x20

#: Scanning tasks for each core of the cluster.
TASKS_PER_CORE = 2

_ENDS = ".,;:!?\n\x0b\x0c\r"
_TO_PIECES = bytes.maketrans((string.ascii_uppercase + _ENDS + "\t").encode(), (string.ascii_lowercase + "\n" * len(_ENDS) + " ").encode())
#: Odd multipliers that mix the hashes. Fixed values, any odd ones would do.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Words:
    """The words of some texts: codes, the text and piece of each, the distinct words by code."""

    def __init__(self, texts: list[bytes]):
        pieces = [t.split(b"\n") for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([p.decode() for t in pieces for p in t], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.known: list[str] = coded.dictionary.to_pylist()
        piece = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        # an empty word may stand where a piece begins or ends with blanks
        real = np.array([w != "" for w in self.known], bool)
        keep = real[codes] if len(codes) else np.zeros(0, bool)
        self.codes, self.piece = codes[keep], piece[keep]
        self.text = np.repeat(np.arange(len(texts)), [len(t) for t in pieces])[self.piece]

    def __len__(self) -> int:
        return len(self.codes)


def _hashes(words: Words, langs: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: length, places of the first words of all phrases, and the phrases' 64-bit hashes."""
    if not len(words):
        return
    own = np.array([xxhash.xxh64_intdigest(w) for w in words.known], np.uint64)[words.codes]
    by_lang = {k: xxhash.xxh64_intdigest(k, 1) for k in set(langs)}
    state = np.array([by_lang[k] for k in langs], np.uint64)[words.text]
    places = np.arange(len(words))
    for length in range(1, LONGEST + 1):
        last = places + length - 1
        inside = last < len(words)
        inside[inside] = words.piece[last[inside]] == words.piece[places[inside]]
        places = places[inside]
        if not len(places):
            return
        state = (state[inside] ^ own[places + length - 1]) * _MIX[0]
        state ^= state >> np.uint64(29)
        mixed = state * _MIX[1]
        yield length, places, mixed ^ (mixed >> np.uint64(32))


def _cells(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch; rows take bits of their own."""
    return [((hashes >> np.uint64(27 * r)) & np.uint64(cells - 1)).astype(np.uint32) for r in range(ROWS)]


def _of_round(hashes: np.ndarray, number: int, rounds: int) -> np.ndarray:
    return (hashes >> np.uint64(54)) % np.uint64(rounds) == np.uint64(number) if rounds > 1 else np.ones(len(hashes), bool)


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of about so many bytes, cut between pieces, so that no phrase is cut."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(b"\n", at, at + most)
        end = end if end >= 0 else text.find(b"\n", at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts with small letters and a line end between pieces, in parts of bounded size but for longer pieces."""
    for batch in batches:
        for part in slices(batch, batch.column("text"), 4096, most):
            langs, texts = part.column("lang").to_pylist(), [t.translate(_TO_PIECES) for t in part.column("text").cast(pa.large_binary()).to_pylist()]
            if len(texts) == 1 and len(texts[0]) > most:
                yield from ((langs, [t]) for t in _cut(texts[0], most))
            else:
                yield langs, texts


def _counter(least: int) -> type:
    """Holds any count that matters: sums stop at what is no less than least."""
    return np.uint8 if least < 256 else np.uint16


def _coded(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Cells as steps from one to the next and their counts; both are small numbers, which packs them well."""
    return pa.compress(np.diff(cells, prepend=np.uint16(0)).tobytes() + counts.tobytes(), codec="zstd", asbytes=True)


def _decoded(coded: bytes, n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    plain = pa.decompress(coded, n * (2 + np.dtype(kind).itemsize), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(plain, np.uint16, n), dtype=np.int64), np.frombuffer(plain, kind, n, 2 * n)


def _sketcher(cells: int, number: int, rounds: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows row, block, n, counted: n cells of the block and their counts (up to the counter's largest) of the phrases of a task."""
    kind = _counter(least)

    def sent(row: int, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, count = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.flatnonzero(np.diff(cell // BLOCK)) + 1
        at, counts = np.split((cell % BLOCK).astype(np.uint16), cuts), np.split(np.minimum(count, np.iinfo(kind).max).astype(kind), cuts)
        blocks = [int(c) // BLOCK for c in cell[np.concatenate([[0], cuts]).astype(np.int64)]]
        coded = [_coded(a, c) for a, c in zip(at, counts, strict=True)]
        yield pa.record_batch({"row": pa.array([row] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int32()), "n": pa.array([len(a) for a in at], pa.int32()), "counted": pa.array(coded, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(ROWS)], 0
        for langs, texts in _batches(batches):
            for _, _, hashes in _hashes(Words(texts), langs):
                hashes = hashes[_of_round(hashes, number, rounds)]
                for row, cell in enumerate(_cells(hashes, cells)):
                    held[row].append(cell)
                size += len(hashes)
            if size >= _GATHERED:
                for row in range(ROWS):
                    yield from sent(row, held[row])
                held, size = [[] for _ in range(ROWS)], 0
        if size:
            for row in range(ROWS):
                yield from sent(row, held[row])

    return run


def _summer(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows row, block, bits: the cells whose sum reaches least. A sum stops at 65,535, far above any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                at, count = _decoded(r["counted"], r["n"], _counter(least))
                mine = sums.setdefault((r["row"], r["block"]), np.zeros(BLOCK, np.uint16))
                mine[at] = np.minimum(mine[at].astype(np.uint32) + count, 65_535)
        hot = {k: v >= least for k, v in sums.items()}
        hot = {k: np.packbits(v, bitorder="little").tobytes() for k, v in hot.items() if v.any()}
        yield pa.record_batch({"row": pa.array([k[0] for k in hot], pa.int32()), "block": pa.array([k[1] for k in hot], pa.int32()), "bits": pa.array(hot.values(), pa.binary())})

    return run


class _Sent:
    """What a task has sent already, by two hashes of 64 bits; where the first of them is that of another phrase, it may be sent again.

    The hashes are sorted runs, each more than twice as long as the next, so that each is merged a few times only.
    """

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(first) for first, _ in self.runs)

    def new(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.ones(len(first), bool)
        for firsts, seconds in self.runs:
            left = np.flatnonzero(out)
            at = np.minimum(np.searchsorted(firsts, first[left]), len(firsts) - 1)
            out[left] = (firsts[at] != first[left]) | (seconds[at] != second[left])
        return out

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        if not len(first):
            return
        while True:
            first, once = np.unique(first, return_index=True)
            second = second[once]
            if not self.runs or len(self.runs[-1][0]) > 2 * len(first):
                break
            firsts, seconds = self.runs.pop()
            first, second = np.concatenate([firsts, first]), np.concatenate([seconds, second])
        self.runs.append((first, second))


#: Phrases that a task remembers to have sent; beyond it begins anew.
_REMEMBERED = 1 << 22


def _finder(bits, cells: int, number: int, rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows lang, phrase, mostly once for each task: the phrases whose cells are all hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sent = [np.frombuffer(b, np.uint8) for b in bits.value], _Sent()
        for langs, texts in _batches(batches):
            words, got = Words(texts), {}
            other = np.array([xxhash.xxh64_intdigest(w, 2) for w in words.known], np.uint64)[words.codes] if len(words) else None
            firsts, seconds = [], []
            for length, places, hashes in _hashes(words, langs):
                good = _of_round(hashes, number, rounds)
                for row, cell in enumerate(_cells(hashes, cells)):
                    good &= (hot[row][cell >> 3] >> (cell & np.uint32(7)).astype(np.uint8)) & 1 == 1
                places, first = places[good], hashes[good]
                second = np.full(len(places), length, np.uint64)
                for i in range(length):
                    second = second * _MIX[1] + other[places + i]
                new = sent.new(first, second)
                for at in places[new]:
                    got[langs[words.text[at]], " ".join(words.known[c] for c in words.codes[at : at + length])] = None
                firsts.append(first[new])
                seconds.append(second[new])
            if got:
                if len(sent) > _REMEMBERED:
                    sent = _Sent()
                sent.add(np.concatenate(firsts), np.concatenate(seconds))
                yield pa.record_batch({"lang": pa.array([k for k, _ in got], pa.string()), "phrase": pa.array([p for _, p in got], pa.string())})

    return run


def guarded(text: bytes) -> str:
    """The words with one space before, between and after them, and a line end between pieces, of a text with line ends between its pieces."""
    text = b" " + text.replace(b"\n", b" \n ") + b" "
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.decode()


class WordCodes:
    """A code of as many digits for each word of some phrases. No code begins inside another, so that only whole words match."""

    def __init__(self, phrases: pa.Array):
        lists = pc.ascii_split_whitespace(phrases)
        coded = lists.flatten().dictionary_encode()
        self._phrases, self._ends = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        self._places = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        self.digits = 2 if len(self._places) <= _DIGITS**2 else 3
        # no more letters than needed, as the automaton looks through a state's letters one by one
        base = next(b for b in range(1, len(self._places) + 2) if b**self.digits >= len(self._places))
        places = np.arange(len(self._places))
        self._codes = np.stack([_DIGITS * (i + 1) + places // base ** (self.digits - 1 - i) % base for i in range(self.digits)], axis=1).astype(np.uint16)

    def phrases(self) -> Iterator[str]:
        """The codes of the phrases, in their order."""
        plain, ends = self._codes[self._phrases].tobytes().decode("utf-16-le"), ((self._ends - self._ends[0]) * self.digits).tolist()
        return (plain[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    def places(self, known: list[str]) -> np.ndarray:
        """The place of each word, or one beyond all where no phrase has it."""
        return np.array([self._places.get(w, len(self._places)) for w in known], np.int64)

    def coded(self, places: np.ndarray, pieces: np.ndarray) -> str:
        """Words by their places as one text, with a blank before each piece and for each word that no phrase has."""
        out = np.full((len(places), self.digits + 1), _BLANK, np.uint16)
        real = places < len(self._places)
        out[real, 1:] = self._codes[places[real]]
        used = np.repeat(real[:, None], self.digits + 1, axis=1)
        used[:, 0] = ~real | (np.diff(pieces, prepend=-1) != 0)
        return out[used].tobytes().decode("utf-16-le")


def compile_automata(phrases: Iterable[tuple[str, object]], coded: Iterable[str] | None = None) -> dict[str, tuple[ahocorasick.Automaton, list]]:
    """An automaton for each language, whose words give the place of a phrase in the language's list.

    coded: what is looked for instead of each phrase; without it, its letters between blanks, as in guarded texts.
    """
    if coded is None:
        phrases = list(phrases)
        coded = (f" {p} " for _, p in phrases)
    by_lang: dict[str, tuple[ahocorasick.Automaton, list]] = {}
    for (lang, phrase), code in zip(phrases, coded, strict=True):
        if lang not in by_lang:
            by_lang[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        automaton, known = by_lang[lang]
        automaton.add_word(code, len(known))
        known.append(phrase)
    for automaton, _ in by_lang.values():
        automaton.make_automaton()
    return by_lang


def _scanner(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows lang, phrase, n of the phrases of sent that a task's texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        phrases, langs = (pa.concat_arrays(table[c].cast(pa.large_string()).chunks or [pa.array([], pa.large_string())]) for c in ("phrase", "lang"))
        codes, langs = WordCodes(phrases), langs.dictionary_encode()
        names = langs.dictionary.to_pylist()
        # phrases are known by their rows, as so many texts would fill the worker
        automata = compile_automata(zip((names[i] for i in langs.indices.to_numpy()), range(len(phrases)), strict=True), codes.phrases())
        automata = {lang: (automaton, np.array(rows)) for lang, (automaton, rows) in automata.items()}
        counts = {lang: np.zeros(len(rows), np.int64) for lang, (_, rows) in automata.items()}
        for in_langs, texts in _batches(batches):
            words = Words(texts)
            places = codes.places(words.known)[words.codes]
            for lang in automata.keys() & set(in_langs):
                mine = np.array([k == lang for k in in_langs])[words.text]
                hits = np.fromiter(map(itemgetter(1), automata[lang][0].iter(codes.coded(places[mine], words.piece[mine]))), np.int64)
                if len(hits) * 8 > len(counts[lang]):
                    counts[lang] += np.bincount(hits, minlength=len(counts[lang]))
                else:
                    np.add.at(counts[lang], hits, 1)
        for lang, n in counts.items():
            for at in np.array_split(np.flatnonzero(n), max(1, len(n) // 10_000)):
                yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "phrase": phrases.take(pa.array(automata[lang][1][at])).cast(pa.string()), "n": pa.array(n[at])})

    return run


def candidates(texts: DataFrame, min_count: int, cells: int | None = None, rounds: int | None = None) -> DataFrame:
    """lang, phrase of one to LONGEST words, each once, from lang and text: all that occur min_count times, and a few others."""
    spark = texts.sparkSession
    if not 1 <= min_count <= 65_535:
        raise ValueError("min_count has to be from 1 to 65,535")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = 1 << max(0, (size // BYTES_PER_CELL) - 1).bit_length()
    cells = cells or min(MOST_CELLS, max(FEWEST_CELLS, wanted))
    rounds = rounds or min(1024, max(1, wanted // MOST_CELLS))
    out = None
    for number in range(rounds):
        counted = texts.mapInArrow(tidy(_sketcher(cells, number, rounds, min_count)), "row int, block int, n int, counted binary")
        blocks = ROWS * cells // BLOCK
        summed = counted.repartition(max(min(shuffle_partitions(spark), blocks), blocks // 512), "row", "block").mapInArrow(tidy(_summer(min_count)), "row int, block int, bits binary")
        bits = [bytearray(cells // 8) for _ in range(ROWS)]
        for r in summed.collect():
            bits[r["row"]][r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = r["bits"]
        sent = spark.sparkContext.broadcast([bytes(b) for b in bits])
        found = checkpoint(texts.mapInArrow(tidy(_finder(sent, cells, number, rounds)), "lang string, phrase string").distinct())
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def count_phrases(texts: DataFrame, wanted: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """lang, phrase, f: how often each phrase of wanted (distinct rows lang, phrase) occurs in its language's texts."""
    spark = texts.sparkSession
    size = wanted.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = -(-size // automaton_bytes)
    part = F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, parts)))
    out = spark.createDataFrame([], "lang string, phrase string, f long")
    for i in range(parts):
        sent = spark.sparkContext.broadcast(_packed(wanted.filter(part == i).select("lang", "phrase").toArrow()))
        counted = checkpoint(texts.mapInArrow(tidy(_scanner(sent)), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")))
        sent.destroy()
        out = counted if i == 0 else out.unionByName(counted)
    return out


def _parts(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(counts: DataFrame, totals: DataFrame, min_count: int, inside_percent: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words and more that no longer one covers.

    counts: lang, phrase, f, with all parts of a phrase that it has; totals: lang, n.
    """
    known = counts.filter(F.col("f") >= min_count)
    words = F.split("phrase", " ")
    phrases = known.filter(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _parts(F.col("w"), 1, F.col("k")).alias("head"), _parts(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    heads, tails = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    # 38 digits hold these products up to some 10 ** 17 words a language
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(least.alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    # the phrases that lie inside a longer one, each with the largest count of those
    starts = phrases.select("lang", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("first"))
    spans = starts.select("lang", "a", "w", "first", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("w") - F.col("first") + 1))).alias("size")).filter((F.col("size") < F.size("w")) & (F.col("first") + F.col("size") - 1 <= F.size("w")))
    inner = spans.select("lang", _parts(F.col("w"), F.col("first"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.lit(100).cast("long") * F.col("longer") >= F.lit(inside_percent).cast("long") * F.col("a")
    return best.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer")


def top_phrases(found: DataFrame, top: int) -> DataFrame:
    """The first rows of each language, ranked; first by parts, so that no task sorts a whole language."""
    order = "ORDER BY score DESC, a DESC, phrase"
    salts = shuffle_partitions(found.sparkSession)
    some = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).filter(F.col("rank") <= top)
    return some.drop("salt").withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, top: int = 2000, inside_percent: int = 100, cells: int | None = None, rounds: int | None = None, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of two to five words that occur min_count times, by score.

    A null language counts as "und", a null text as empty. Repeated rows count once each, ids and
    other columns aren't read, very long texts are scanned whole, ties are ranked by count and
    phrase. A language without words or without such a phrase has no rows; neither has an empty
    table. Of a phrase's cuts the one with the lowest score counts, of equals the first.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # each task sends a phrase once, so few long tasks, which stream their texts, send less than many
    texts = texts.coalesce(TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    counts = checkpoint(count_phrases(texts, candidates(texts, min_count, cells, rounds), automaton_bytes))
    words = F.array_remove(F.split("text", r"[.,;:!?\x09-\x0D\x20]+"), "")
    totals = texts.groupBy("lang").agg(F.sum(F.size(words).cast("long")).alias("n"))
    return top_phrases(scored(counts, totals, min_count, inside_percent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
