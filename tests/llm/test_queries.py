"""The registered queries over a small folder of tables with odd rows: columns, splits and values."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from voxelgate.llm import queries  # noqa: E402

WORDS = {"aa": ["the", "thing", "andon", "ering"], "bb": ["eauque", "tré", "ouqu", "leçon"]}
TEXTS = {}
COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score rejected",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_exact_top_k": "query_id rank vec_id score",
    "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_ngram_join": "doc_id n_shingles component_id n_links",
    "op9_quality": "doc_id held_out score predicted",
    "op10_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_line_dedup": "doc_id n_lines n_dropped kept_sha256",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("tables"), random.Random(3)
    rows = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 60))), lang))
    rows += [(200 + i, f"New York City is large. A line that is in many texts\nnumber {i}", "aa") for i in range(120)]
    rows += [(100, rows[0][1].replace(" ", "\t"), "bb"), (101, rows[1][1] + " end", "aa"), (102, None, "aa"), (103, "", None), (104, "12 ² ½ ① !", None), (105, "mail a@b.cc from 10.0.0.1\nunder the MIT  License", "aa"), (106, "x" * 20_000, None)]
    TEXTS.update({i: t for i, t, _ in rows})
    spark.createDataFrame([(i, t, k, "src", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    numbers = np.random.default_rng(1)
    spark.createDataFrame([(i, numbers.normal(0, 1, 4).tolist(), 0) for i in range(120)] + [(150, None, 0), (151, [float("nan")] * 4, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows(spark, folder):
    held = {}

    def get(name):
        if name not in held:
            df = queries.QUERIES[name](spark, folder)
            assert df.columns == COLUMNS[name].split()
            held[name] = df.collect()
        return held[name]

    return get


def crc(i):
    return zlib.crc32(str(i).encode())


def same_as_sql(rows, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(queries.SQL[name])
    order = [COLUMNS[name].split().index(d[0]) for d in want.description]
    assert sorted(tuple(r[i] for i in order) for r in rows(name)) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(rows, folder, name):
    same_as_sql(rows, folder, name)


def test_language_id(rows):
    got = {r.doc_id: r for r in rows("op1_language_id")}
    assert set(got) == set(TEXTS) and all(r.held_out == (crc(i) % 4 == 2) for i, r in got.items())
    assert [got[i].lang_pred for i in (102, 103, 104)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(80)]) > 0.95


def test_sharding(rows):
    slots = {}
    for r in rows("op3_sharding"):
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == len(TEXTS) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_personal_data_and_licenses(rows):
    (r,) = [r for r in rows("op4_pii") if r.doc_id == 105]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0) and r.spans.startswith("email:5:11,ip:17:25")
    assert r.base_sha256 == hashlib.sha256(b"email:5:11,ip:17:25").hexdigest()
    (r,) = [r for r in rows("op5_licenses") if r.doc_id == 105]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (13, 1, 11, 11, "mit", 1.0)


def test_packing(rows):
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    places = {}
    for r in rows("op7_packing"):
        ids = [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False)) and min(spans)[0] == 0


def test_quality(rows):
    got = rows("op9_quality")
    assert {r.doc_id for r in got} == set(TEXTS) and all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert np.mean([scores[i] > 0.5 for i in range(1, 80, 2)]) > 0.9 > 0.1 > np.mean([scores[i] > 0.5 for i in range(0, 80, 2)])


def test_byte_bpe(rows):
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows("op10_byte_bpe"):
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
