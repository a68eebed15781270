"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm import alignment, automaton, covertree, linedup, media, mixing, ngrams, pieces, quality, sanitise, secrets, simhash, veccodes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"), width=3, max_distance=3)
    return groups.select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.span_digests(sanitise.find_personal_data(_table(spark, sf_dir, "documents")))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_slots", F.coalesce("first_slot", F.lit(-1).cast("long")).alias("first_slot"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.removed_lines(_table(spark, sf_dir, "documents"), shortest=1)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def vocabulary_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def piece_model() -> bytes:
    """The model that op6 encodes with."""
    return vocabulary_file("piece_bpe_32k.model")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pieces.encode_documents(_table(spark, sf_dir, "documents"), piece_model()))


def piece_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_documents(_table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.link_vectors(_table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as of good quality and not toxic."""
    return _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir)).where("kept")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json").decode(), piece_model())


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.encode_vectors(_table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = automaton.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json").decode())
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash, op2_pii, op3_mix, op4_lines, op5_media, op6_pieces, op7_lm, op8_embeddings, op9_secrets, op10_quality, op11_align, op12_codes, op13_bpe]
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, 3 * source_size / ((rank - 1) % 3 + 1) AS cap_by_weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level FROM w WINDOW o AS (ORDER BY cap_by_weight, rank)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, (cap_by_weight, rank)) FROM l WHERE level <= cap_by_weight)) AS target FROM l),
q AS (SELECT *, round(target)::BIGINT AS quota, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM t),
b AS (SELECT *, sum(quota) OVER () AS total, sum(quota) OVER (ORDER BY rank) AS upto, greatest(1, least(1024, (sum(quota) OVER () + 262143) // 262144)) AS words FROM q),
n AS (SELECT i AS slot, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS point FROM range((SELECT coalesce(max((total + words - 1) // words), 0)::BIGINT FROM b)) r(i)),
s2 AS (SELECT slot, rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS block FROM n JOIN b ON point >= (upto - quota)::DOUBLE / total::DOUBLE AND point < upto::DOUBLE / total::DOUBLE),
g AS (SELECT b.*, (SELECT count(*) FROM s2 WHERE s2.rank = b.rank) AS n_slots FROM b),
p AS (SELECT d.*, g.rank, source_size, target, words, n_slots, least(3 * source_size, n_slots * words) AS quota, sum(size) OVER (PARTITION BY d.source ORDER BY md5('7|' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + source_size + size, quota) - start - source_size) + greatest(0, least(start + 2 * source_size + size, quota) - start - 2 * source_size))::BIGINT AS taken FROM p)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, taken, n_slots::BIGINT AS n_slots, coalesce(slot, -1)::BIGINT AS first_slot FROM k LEFT JOIN s2 ON k.taken > 0 AND s2.rank = k.rank AND s2.block = (k.start // k.words)
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and means one after the other, over vectors of the same length."""
    near = "SELECT r, p.part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, v.part, entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN b{} b ON v.part = b.part) p GROUP BY r, p.part"
    ctes = [
        "k AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS (SELECT vec_id, label, r, part, list_transform(e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}], lambda x: floor({veccodes.SCALE} * x::DOUBLE)::BIGINT) AS x FROM k, range({parts}) t(part))",
        f"b0 AS (SELECT part, r - 1 AS entry, x FROM v WHERE r <= {entries})",
    ]
    for i in range(rounds):
        ctes.append(f"a{i} AS ({near.format(i)})")
        ctes.append(f"m{i} AS (SELECT part, entry, list(y ORDER BY i) AS x FROM (SELECT part, entry, i, floor(sum(y) / count(*))::BIGINT AS y FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v JOIN a{i} USING (r, part)) GROUP BY part, entry, i) GROUP BY part, entry)")
        ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry))")
    ctes.append(f"a AS ({near.format(rounds)})")
    ctes.append("c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a GROUP BY r)")
    digest = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds})"
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM c JOIN k USING (r)"


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": OP3_SQL, "op8_embeddings": OP8_SQL, "op12_codes": op12_sql()}
