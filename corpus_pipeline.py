"""Training-data pipeline over ``documents``: language ID, near-duplicates,
decontamination, secrets, tokenisation.

Each stage takes all that its predecessor kept and returns a DataFrame, which
is written as Parquet to the shared folder and read again. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, langid, pieces, secrets, simhash
from threadlens.llm.common import materialize, read

#: Language ID rejects a document without a letter, and one whose best language has no more evidence than the others together.
MIN_LANG_SCORE = 0.5


def _as_row(docs: DataFrame) -> DataFrame:
    """(row, text): the columns of ``docs`` as one, so that none meets a name an operator uses."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10, learnt from the labelled rows of ``docs``; rejected documents go."""
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(_as_row(docs), model, ["row"])
    accepted = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANG_SCORE)
    return found.filter(accepted).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7; the document with the smallest id of each group stays. Rows with
    one id rank by a hash of the whole row (a null id comes first); of rows
    that are equal in every column one stays."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    key = F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row").alias("hash"))
    groups = simhash.near_duplicates(rows.select(key.alias("key"), F.col("row.text").alias("text")), "key")
    kept = groups.filter(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("key").agg(F.count("*").alias("n"))
    kept = materialize(kept, "near-duplicates-kept").select("key.doc_id", "key.hash", "n")
    both = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row") == F.col("hash"))
    of = lambda times: rows.join(kept.filter(times), both, "left_semi").select("row.*")
    if kept.filter("n > 1").isEmpty():
        return of("n = 1")
    return of("n = 1").unionByName(of("n > 1").dropDuplicates())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8; documents that hold a benchmark window go."""
    found = decontaminate.contamination(_as_row(docs), read(spark, sf_dir, "benchmark"), ["row"])
    return found.filter(F.size("hit_spans") == 0).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3; secrets are replaced in the text, n_chars follows."""
    clean = secrets.redact(secrets.find_secrets(_as_row(docs)))
    changed = F.size("secret_spans") > 0
    new = F.col("row").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("long"))
    return clean.select(F.when(changed, new).otherwise(F.col("row")).alias("row")).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9; adds the ids and whether they decode to the text."""
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", tokenize),
]

#: SQL has no XXH64, so it cannot make the fingerprints; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
