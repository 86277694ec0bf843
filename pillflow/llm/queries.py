"""The registered queries of these operators, with the parameters they would have in production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pillflow.llm import collide, identifiers, kdtree, langid, mixture, near, packing, phrases, piece_bpe, rans, suffixes, toxicity, vectors, whitening
from pillflow.llm.common import crc32_of, read

SEQUENCE_TOKENS = 4096
SHARDS = 24
REPEATED_BYTES = 400
TOXIC_FROM = 0.3
COMPONENTS = 32


def op1_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(F.pmod(crc32_of("doc_id"), F.lit(4)) != 2)
    model = toxicity.learn(documents.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    held_out = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    scored = toxicity.score(documents.select("doc_id", held_out, "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = rans.tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    table, blocks = rans.write_container(spark, tokens, rans.count_tokens(tokens), "rans")
    return rans.starts_of(rans.read_container(spark, table, blocks), blocks)


def op3_bloom_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of("doc_id"), F.lit(5)) == 0
    documents = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    model = langid.learn(documents.where("not held_out").select("text", "lang"))
    return langid.identify(documents.select("doc_id", "held_out", "text"), model).drop("text")


def op4_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(read(spark, sf_dir, "documents"), REPEATED_BYTES)


def op5_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    classes = near.near_duplicates(documents)
    alone = documents.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return classes.unionByName(alone)


def op6_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("vec", lambda x: F.floor(x * 256).cast("double")).alias("vec")
    rows = vectors.usable_vectors(read(spark, sf_dir, "embeddings")).select("vec_id", whole)
    return kdtree.top_products(rows, rows.where(F.pmod("vec_id", F.lit(50)) == 0), k=5)


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_bpe.serialise(piece_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return piece_bpe.digest_round_trip(read(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=SEQUENCE_TOKENS)
    return packing.pack(pieces, SEQUENCE_TOKENS)


def op9_collision_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.usable_vectors(read(spark, sf_dir, "embeddings")).where(F.exists("vec", lambda x: x != 0))
    return collide.nearest(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0), k=10)


def op10_mixture_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = mixture.interleave(rows, SHARDS, "source", ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), support=30, percent=80, first=2000)


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened, model = whitening.whiten(read(spark, sf_dir, "embeddings"), COMPONENTS)
    return whitening.by_component(whitened, model)


def op13_offset_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return identifiers.digest(identifiers.find_identifiers(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_label_model, op2_rans_tokens, op3_bloom_languages, op4_induced_suffixes, op5_weighted_minhash, op6_kd_trees, op7_piece_bpe, op8_swap_packing, op9_collision_lines, op10_mixture_shards,
        op11_son_phrases, op12_jacobi_davidson, op13_offset_transducers)
}

#: SQL for DuckDB where it can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op6_kd_trees": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS vec FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.vec, v.vec) AS BIGINT) AS score
            FROM whole q JOIN whole v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_son_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        numbered AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered),
        runs AS (
            SELECT lang, w1, lead(w1, 1) OVER t AS w2, lead(w1, 2) OVER t AS w3, lead(w1, 3) OVER t AS w4
            FROM words WINDOW t AS (PARTITION BY piece ORDER BY i)),
        grams AS (
            SELECT lang, 1 AS k, w1 AS phrase FROM runs
            UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
            UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
            UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL),
        f AS (SELECT lang, k, phrase, lang || chr(10) || phrase AS key, count(*) AS a FROM grams GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
        cuts AS (
            SELECT lang, phrase, a, j, lang || chr(10) || array_to_string(w[1:j], ' ') AS lp,
                lang || chr(10) || array_to_string(w[j + 1:], ' ') AS rp
            FROM candidates, unnest(range(1, k)) AS places(j)),
        scores AS (
            SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS BIGINT) AS score
            FROM cuts c JOIN f x ON x.key = c.lp JOIN f y ON y.key = c.rp),
        weakest AS (
            SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_ AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM candidates, (VALUES (2), (3)) AS ms(m), unnest(range(1, k - m + 2)) AS places(i)
            WHERE m < k GROUP BY ALL),
        ranked AS (
            SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank
            FROM weakest w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase
            WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(w.a AS HUGEINT))
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
