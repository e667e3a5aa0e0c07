"""The pipeline against brute force over a folder of its own, and each query over its whole table."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import queries

from .test_operators import exact_brute, groups_brute


def make_folder(spark, path):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "sa") for b in ("ra", "te", "pi", "go", "du", "shem", "tok")]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "hatefully"]))
        if i % 17 == 3:
            words = docs[i - 2][1].split()
            toxic = (i - 2) % 5 == 0
        docs.append((i, " ".join(words), "en", "hot" if i % 3 else f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, {i for i, _, t in labels if t}


def test_pipeline(spark, tmp_path):
    docs, toxic = make_folder(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = [(i, t) for i, t, *_ in docs if i not in toxic]
    once = {i for i, _, _, kept, _ in exact_brute(clean) if kept}
    kept = {c for _, _, c in groups_brute([x for x in clean if x[0] in once])}
    assert {r["doc_id"] for r in out} == kept
    coder = queries.pieces.encoder(queries.model_path())
    texts = {i: t for i, t, *_ in docs}
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, coder.library.encode(texts[r["doc_id"]]))).encode()).hexdigest() for r in out)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Null ids and texts, empty ones, one id with two texts, repeated rows and a column with a name that stages use."""
    docs, _ = make_folder(spark, str(tmp_path / "plain"))
    odd = [(None, None), (401, ""), (402, " \n"), (403, "lone words stand here"), (403, "another text of that id"), (403, "lone words stand here"), (None, "some nameless text"), (None, "second nameless text")]
    odd = [(i, t, None, None if i is None else "s1", None) for i, t in odd]
    (tmp_path / "odd").mkdir()
    spark.createDataFrame([*docs, *odd], "doc_id long, text string, lang string, source string, n_chars long").withColumn("part", F.lit(1)).withColumn("fp", F.lit("x")).write.parquet(str(tmp_path / "odd/documents.parquet"))
    spark.read.parquet(str(tmp_path / "plain/labels.parquet")).write.parquet(str(tmp_path / "odd/labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    plain = corpus_pipeline.run(spark, str(tmp_path / "plain")).collect()
    coder = queries.pieces.encoder(queries.model_path())

    def digest(text):
        return hashlib.sha256(",".join(map(str, coder.library.encode(text))).encode()).hexdigest()

    stay = {(402, digest(" \n")), (403, digest(odd[3][1])), (403, digest(odd[4][1])), (None, digest(odd[6][1])), (None, digest(odd[7][1]))}
    assert {(r["doc_id"], r["ids_sha256"]) for r in out} == {(r["doc_id"], r["ids_sha256"]) for r in plain} | stay


def test_pipeline_of_empty_tables(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_queries_cover_the_table(spark):
    d = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    for name, query in queries.queries().items():
        found = {r.doc_id for r in query(spark, d).select("doc_id").collect()}
        assert found <= ids and (found == ids or name.startswith("op1_")), name
