"""The registered queries of this package and their SQL in a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import (
    ann, divergence, language_id, line_dedup, ngram_join, packing, quality, segmentation, substring_dedup, topk_search, toxicity,
    vector_codes, warc,
)
from kerbline.llm.common import vectors_of
from kerbline.session import Written

SCALE = 1024


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = vectors_of(table(spark, folder, "embeddings"), "vec_id", "embedding", "true")
    vectors = vectors.select("id", F.transform("vec", lambda x: F.floor(x * SCALE)).alias("vec"))
    return topk_search.exact_top_k(vectors, vectors.where("id % 100 = 0"), 10)


def remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; rows without id have none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op2_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(documents, labels.where(remainder(5) != 0).select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json")))


def op5_nbest_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return segmentation.digest(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(table(spark, folder, "documents"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op8_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = vectors_of(table(spark, folder, "embeddings"), "vec_id", "embedding", "exists(vec, x -> x <> 0)")
    return ann.nearest(vectors, vectors.where("id % 100 = 0"), 10)


def op9_quality_pu(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(documents, labels.where((remainder(3) != 1) & (F.col("quality") == 1)))
    scored = quality.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_records(table(spark, folder, "pages"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents, written = table(spark, folder, "documents"), Written(spark, "language")
    statistics = language_id.train(documents.where(remainder(3) != 1), written)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return language_id.predict(documents, statistics, written).select("doc_id", held_out, "lang_pred", "score")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_toxicity": op3_toxicity,
    "op4_bestfit_packing": op4_bestfit_packing,
    "op5_nbest_pieces": op5_nbest_pieces,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_ann": op8_ann,
    "op9_quality_pu": op9_quality_pu,
    "op10_warc": op10_warc,
    "op11_language_id": op11_language_id,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        WITH ok AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
                    WHERE vec_id IS NOT NULL AND len(embedding) > 0
                      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
                   FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) + 1)) AS i FROM d),
        w AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS phrase FROM p WHERE i + 12 <= n),
        f AS (SELECT phrase, min(doc_id) AS first FROM w GROUP BY phrase),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM w JOIN f USING (phrase) WHERE first < doc_id),
        k AS (SELECT p.doc_id, string_agg(p.words[p.i], ' ' ORDER BY p.i) FILTER (WHERE r.i IS NULL) AS kept, count(r.i) AS gone
              FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i GROUP BY p.doc_id)
        SELECT d.doc_id, len(d.words) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS shingle
              FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
                  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
                  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM w LEFT JOIN n USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
        SELECT p.page_id, p.n AS payload_bytes, sha256(p.h) AS payload_digest,
               CASE WHEN p.page_id > g.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id > g.first THEN g.first END AS refers_to
        FROM p LEFT JOIN g ON p.h = g.h""",
    "op12_vector_codes": """
        WITH ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
                    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS (SELECT vec_id, part, pos, v[part * (len(v) // 16) + pos + 1] AS x
              FROM (SELECT vec_id, v, part, unnest(range(len(v) // 16)) AS pos FROM (SELECT vec_id, v, unnest(range(16)) AS part FROM ok))),
        b0 AS (SELECT part, entry, pos, x FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM ok) USING (vec_id) WHERE entry < 64),
        a1 AS (SELECT vec_id, part, entry FROM (SELECT vec_id, c.part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b0 b ON b.part = c.part AND b.pos = c.pos GROUP BY vec_id, c.part, entry)
               QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1),
        m1 AS (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM c JOIN a1 USING (vec_id, part) GROUP BY part, entry, pos),
        b1 AS (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM b0 LEFT JOIN m1 USING (part, entry, pos)),
        a2 AS (SELECT vec_id, part, entry FROM (SELECT vec_id, c.part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b1 b ON b.part = c.part AND b.pos = c.pos GROUP BY vec_id, c.part, entry)
               QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1),
        m2 AS (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM c JOIN a2 USING (vec_id, part) GROUP BY part, entry, pos),
        b2 AS (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM b1 LEFT JOIN m2 USING (part, entry, pos)),
        a3 AS (SELECT vec_id, part, entry, d FROM (SELECT vec_id, c.part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b2 b ON b.part = c.part AND b.pos = c.pos GROUP BY vec_id, c.part, entry)
               QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1),
        r AS (SELECT vec_id, string_agg(substr('0123456789abcdef', CAST(entry // 16 AS INTEGER) + 1, 1) || substr('0123456789abcdef', CAST(entry % 16 AS INTEGER) + 1, 1), '' ORDER BY part) AS code, sum(d) AS error FROM a3 GROUP BY vec_id),
        l AS (SELECT label, sum(error) AS label_error FROM r JOIN ok USING (vec_id) GROUP BY label),
        h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2)
        SELECT r.vec_id, r.code, CAST(r.error AS BIGINT) AS error, CAST(l.label_error AS BIGINT) AS label_error, h.codebooks_sha256
        FROM r JOIN ok USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM ok.label CROSS JOIN h""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT lang, source, coalesce(v.v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
              LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source)),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS HUGEINT) AS p
              FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        l AS (SELECT lang, term, CAST(1 + 1000000000 * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS HUGEINT) AS q
              FROM c GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) f
                  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - l.q) * (p.p - l.q) // l.q AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q),
        u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM u QUALIFY part = 'pair' OR rank <= 200""",
}
