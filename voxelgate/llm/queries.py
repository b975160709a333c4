"""The thin queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, pii, quality
from .byte_bpe import bpe_round_trip
from .collocations import collocations
from .common import checkpoint, crc_mod, table
from .exact_dedup import exact_dedup
from .filter_audit import flag_documents, replay
from .line_dedup import drop_repeated_lines
from .ngram_join import near_groups
from .packing import pack
from .sharding import shard_documents
from .top_k import exact_top_k


def tokenizer_path(name: str) -> str:
    """A public vocabulary file of the installation; imported here because only these queries need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs, model).select("row.doc_id", "lang_pred", "score", "rejected").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the spans are searched once; both the model and the decisions take them from there
    spans = checkpoint(pii.find_spans(table(spark, sf_dir, "documents")))
    found = pii.decide(spans, pii.fit_spans(spans))
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[_count_kind(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.index_templates(docs))
    labels = F.array_sort(F.array_union("base_labels", F.transform("found", lambda x: x["label"])))
    share = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select(F.col("row.doc_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), links=True)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    model = quality.fit(docs.select("doc_id", "text"), labels.filter(~held_out).select("doc_id", "quality"))
    scored = quality.score(docs, model).select("row.doc_id", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = replay(flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return replayed.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_sharding, op4_pii, op5_licenses, op6_exact_top_k, op7_packing, op8_ngram_join, op9_quality, op10_byte_bpe, op11_filter_audit, op12_collocations, op13_line_dedup)}

SQL = {
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
             n AS (SELECT doc_id, len(g) AS n FROM s),
             u AS (SELECT doc_id, unnest(g) AS g FROM s),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
             r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
             c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
             k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
        SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(root, n.doc_id) AS component_id, coalesce(k, 0) AS n_links
        FROM n LEFT JOIN c ON c.node = n.doc_id LEFT JOIN k ON k.a = n.doc_id""",
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
             f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                          {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t),
                           'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)} AS x
                   FROM t LEFT JOIN m USING (doc_id)),
             d AS (SELECT part, good, toxic, [x.A, x.B, x.C, x.D, x.E] AS fails FROM f),
             l(i) AS (VALUES (1), (2), (3), (4), (5)),
             o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, array_to_string(list_transform([a.i, b.i, c.i, d.i, e.i], lambda i: chr(64 + i)), '') AS filter_order
                   FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
             r AS (SELECT *, coalesce(list_position(list_transform(o, lambda i: fails[i]), true), 0) AS first FROM d, o),
             s AS (SELECT r.*, l.i AS step, o[l.i] AS letter FROM r, l),
             g AS (SELECT part, filter_order, step, letter, count(*) FILTER (first = 0 OR first > step) AS kept, count(*) FILTER (first = step) AS removed,
                          count(*) FILTER (fails[letter] AND first < step) AS redundant, count(*) FILTER (fails[letter] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
                          count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost
                   FROM s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM g""",
    "op12_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
             w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
             n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
             g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS k(k))),
             f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
             c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f),
             s AS (SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
                   FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:] JOIN n ON n.lang = c.lang),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
             i AS (SELECT lang, g[x:x + m - 1] AS g, max(f) AS longer
                   FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS x FROM f, (VALUES (2), (3), (4)) AS m(m) WHERE m < len(g)) GROUP BY ALL),
             k AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE coalesce(100 * longer < 100 * a, true))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k QUALIFY rank <= 2000""",
    "op13_line_dedup": r"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM t),
             k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             h AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             d AS (SELECT doc_id, line, place, h.key IS NOT NULL AND doc_id <> keep_id AS dropped FROM k LEFT JOIN h USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
}
