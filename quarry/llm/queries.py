"""The ten registered queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, line_dedup, mixing, pieces, quality_model, quality_rules, secrets, simhash, toxicity
from .common import id_fold, table

PIECE_MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    """The tokenizer file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(documents(spark, sf_dir), mixing.Mixture())
    return out.withColumnRenamed("id", "doc_id").drop("doc")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    held = F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False))
    return toxicity.score_toxicity(docs, index).select("doc_id", held.alias("held_out"), "score", "predicted", "nearest", "toxic_neighbours")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest=True)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir), width=4, budget=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality_model.train(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    held = F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False))
    return quality_model.score_quality(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), with_text=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(documents(spark, sf_dir), model_path())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_toxicity, op3_exact_dedup, op4_simhash_near_dedup, op5_quality_model, op6_secret_scan, op7_quality_rules, op8_line_dedup, op9_sentence_pieces, op10_license_scan)
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS squeezed
    FROM documents),
g AS (
    SELECT doc_id, squeezed, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY squeezed) AS group_size
    FROM d WINDOW w AS (PARTITION BY squeezed ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(squeezed) AS text_sha256 FROM g
"""


def op10_sql() -> str:
    values = ", ".join(f"('{s}', '{i}')" for i, s in licenses.SENTENCES.items())
    rules = sorted(licenses.RULES, key=lambda r: -len(r[1]))
    steps, names, counts = [], [], []
    for n, (name, ids) in enumerate(rules):
        pattern = "".join(f"<{i}>" for i in ids)
        steps.append(f"replace(r{n}, '{pattern}', '|') AS r{n + 1}, (length(r{n}) - length(r{n + 1})) // {len(pattern) - 1} AS c{n}")
        names.append(f"CASE WHEN c{n} > 0 THEN '{name}' END")
        counts.append(f"c{n}")
    return rf"""
WITH s AS (
    SELECT doc_id, regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '{licenses.KEEP}', ' ', 'g')), '{licenses.END}') AS parts
    FROM documents),
known(sentence, id) AS (VALUES {values}),
f AS (
    SELECT doc_id, pos - 1 AS position, id
    FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM s) JOIN known ON part = sentence),
g AS (
    SELECT doc_id, count(*) AS n_sentences, string_agg(position || ':' || id, ',' ORDER BY position) AS sequence,
           string_agg('<' || id || '>', '' ORDER BY position) AS r0
    FROM f GROUP BY doc_id),
m AS (SELECT *, {", ".join(steps)} FROM g)
SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(sequence, '') AS sequence,
       coalesce(array_to_string(list_sort(list_distinct([{", ".join(names)}])), ','), '') AS licenses,
       coalesce({" + ".join(counts)}, 0)::BIGINT AS n_matches
FROM documents d LEFT JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same: hashes that DuckDB lacks, models and tokenizers are tested otherwise."""
    return {"op3_exact_dedup": OP3_SQL, "op10_license_scan": op10_sql()}
