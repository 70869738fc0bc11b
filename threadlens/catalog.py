"""Named queries over the given tables: each takes (spark, sf_dir) and returns
a DataFrame. ``oracle.py`` holds the equivalent DuckDB SQL per name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.clean import not_blocked, strip_non_ascii
from threadlens.operators import quality as Q
from threadlens.operators.joins import key_overlap
from threadlens.plans import compare, engagement as E, report as R, users as U
from threadlens.session import scratch_path
from threadlens.sources import fixtures as FX
from threadlens.sources.buckets import append_bucketed, load_user_counts, user_counts_of_loads
from threadlens.sources.readers import read_cols, read_doc_topic, union_sheets
from threadlens.sources.sinks import materialize, read_topic_sheets, write_table, write_topic_sheets
from threadlens.sources.tables import ARTICLE_COLS, COMMENT_COLS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _inputs(spark, d, url: bool = True):
    return (FX.open_comments(spark, d), FX.reactions(spark, d), FX.articles(spark, d, url),
            FX.doc_topic(spark, d))


def _key_rows(spark, d, doc_topic: DataFrame | None = None) -> DataFrame:
    """The compiled rows by keys, written once: several windows read them."""
    c, r, a, t = _inputs(spark, d)
    return materialize(E.compile_keys(c, r, a, t if doc_topic is None else doc_topic), "compiled_keys")


def _full(spark, d, rows: DataFrame) -> DataFrame:
    return E.with_articles(rows, FX.articles(spark, d))


def _top(spark, d, doc_topic: DataFrame | None = None) -> DataFrame:
    """The report's rows with their articles' texts."""
    return _full(spark, d, R.top_comments(_key_rows(spark, d, doc_topic), reuse_input=False))


def _top_keys(spark, d) -> DataFrame:
    """The report's rows by keys (for jobs that use no text)."""
    c, r, a, t = _inputs(spark, d, url=False)
    return R.top_comments(E.compile_keys(c, r, a, t))


# ---- sources, cleaning, filters -------------------------------------------

@query
def q_read_cols(spark, d):
    """The article sheet's columns from a written table that has
    others too, nulls as 'missing', all text."""
    raw = FX.articles_raw(spark, d).withColumn("other", F.lit(1))
    return read_cols(spark, write_table(raw, scratch_path(spark, "articles")), ARTICLE_COLS)


@query
def q_strip_non_ascii(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", strip_non_ascii("text").alias("text"))


@query
def q_filter_blocked(spark, d):
    """P3 on a written comment sheet: the filter on the raw column reaches the scan."""
    path = write_table(FX.comments_raw(spark, d), scratch_path(spark, "comments"))
    return read_cols(spark, path, COMMENT_COLS, where=not_blocked("final_state"))


@query
def q_blocked_count(spark, d):
    return Q.blocked_count(FX.comments(spark, d))


@query
def q_distinct_counts(spark, d):
    c = Q.distinct_counts(FX.comments(spark, d), ["conversation_id"], "comments")
    a = FX.articles(spark, d, url=False).select("title", E.text_key("description").alias("description"))
    a = Q.distinct_counts(a, ["title", "description"], "articles")
    return c.unionByName(a)


@query
def q_distinct_counts_by_month(spark, d):
    """A1 mergeable: sketches of each day written, then merged by month; the
    estimate must be within three standard errors of the exact count."""
    comments = FX.comments(spark, d).withColumn("day", F.substring("written_date", 1, 10))
    columns = ["conversation_id", "author_id"]
    path = write_table(Q.distinct_sketches(comments, ["day"], columns), scratch_path(spark, "day_sketches"))
    month = F.substring("day", 1, 7).alias("month")
    stored = spark.read.schema("day string, column_name string, sketch binary").parquet(path)
    merged = Q.merged_distinct(stored.select(month, "column_name", "sketch"), ["month"])
    exact = comments.groupBy(month).agg(*[F.count_distinct(c).alias(c) for c in columns])
    exact = exact.unpivot(["month"], columns, "column_name", "n_exact")
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 3 * Q.SKETCH_ERROR * F.col("n_exact")
    return exact.join(merged, ["month", "column_name"], "left").select(
        "month", "column_name", "n_exact", F.coalesce(near, F.lit(False)).alias("within_error"))


@query
def q_clean_counts(spark, d):
    return E.clean_reaction_counts(FX.reactions(spark, d))


# ---- joins -----------------------------------------------------------------

@query
def q_comments_reactions_left(spark, d):
    return E.comments_reactions_left(FX.open_comments(spark, d), FX.reactions(spark, d))


@query
def q_comments_articles_left(spark, d):
    c, r, a, _ = _inputs(spark, d)
    return E.comments_articles_left(c, r, a)


@query
def q_engaged_descriptions(spark, d):
    c, r, a, _ = _inputs(spark, d, url=False)
    return E.engaged_descriptions(c, r, a)


@query
def q_reactions_right_join(spark, d):
    return E.reactions_right_join(FX.open_comments(spark, d), FX.reactions(spark, d))


def _buckets(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucketed_messages(spark, d) -> tuple[DataFrame, DataFrame]:
    """Comments and reactions as hand-offs bucketed by message id."""
    n = _buckets(spark)
    return (append_bucketed(FX.comments(spark, d), scratch_path(spark, "comments"), ["conv_message_id"], n),
            append_bucketed(FX.reactions(spark, d), scratch_path(spark, "reactions"), ["message_id"], n))


@query
def q_bucketed_left_join(spark, d):
    """J1 on bucketed hand-offs: the join itself shuffles nothing."""
    return E.comments_reactions_left(*_bucketed_messages(spark, d))


@query
def q_bucketed_right_join(spark, d):
    """J3 on bucketed hand-offs: the join itself shuffles nothing."""
    return E.reactions_right_join(*_bucketed_messages(spark, d))


@query
def q_description_topic_join(spark, d):
    return E.description_topic_join(FX.articles(spark, d), FX.doc_topic(spark, d))


@query
def q_compile_engagement(spark, d):
    return E.compile_engagement(*_inputs(spark, d))


@query
def q_key_overlap(spark, d):
    c, r, a, t = _inputs(spark, d, url=False)
    a, t = a.withColumn("k", E.text_key("description")), t.select(E.text_key("Document_description").alias("k"))
    parts = [
        key_overlap(c, "conv_message_id", r, "message_id").select(F.lit("message_id").alias("pair"), "overlap"),
        key_overlap(c, "conversation_id", a, "conversation_id").select(F.lit("conversation_id").alias("pair"), "overlap"),
        key_overlap(a, "k", t, "k").select(F.lit("description").alias("pair"), "overlap"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- quality measures ------------------------------------------------------

@query
def q_missing_topic_stats(spark, d):
    return Q.missing_topic_stats(E.topic_of_reactions(*_inputs(spark, d, url=False)))


@query
def q_null_counts(spark, d):
    """A7 on doc_topic."""
    return Q.null_counts(FX.doc_topic(spark, d))


@query
def q_duplicate_rows(spark, d):
    """A9 on doc_topic."""
    return Q.duplicate_rows(FX.doc_topic(spark, d))


@query
def q_compiled_uniqueness(spark, d):
    """A10: are the compiled rows unique?"""
    return Q.uniqueness(_key_rows(spark, d))


@query
def q_topic_column_check(spark, d):
    """Which inputs have the Topic column that the report needs."""
    frames = {"compiled": E.compile_keys(*_inputs(spark, d)), "comments": FX.open_comments(spark, d)}
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("source"), "n_rows", F.lit("Topic" in df.columns).alias("has_topic"))
        for name, df in frames.items()]
    return parts[0].unionByName(parts[1])


# ---- doc_topic -------------------------------------------------------------

@query
def q_drop_outliers(spark, d):
    return FX.doc_topic(spark, d).filter(F.col("Topic") != -1)


@query
def q_topic_counts(spark, d):
    return (FX.doc_topic(spark, d).groupBy("Topic").agg(F.count(F.lit(1)).alias("Count"))
            .orderBy("Topic"))


@query
def q_preview_topics(spark, d):
    """The first five rows (a preview; the limit is the feature)."""
    return FX.doc_topic(spark, d).orderBy("Topic", "Document_description").limit(5)


@query
def q_doc_topic_scan(spark, d):
    """S4 + S2: write the doc_topic hand-off and read it back with its schema."""
    path = write_table(FX.doc_topic(spark, d), scratch_path(spark, "doc_topic"))
    return read_doc_topic(spark, path)


@query
def q_topic_summary_scan(spark, d):
    """The model's second hand-off, the topic summary, written and read back."""
    from threadlens.operators.terms import topic_info

    path = write_table(topic_info(FX.doc_topic(spark, d)), scratch_path(spark, "topic_summary"))
    return spark.read.schema("Topic int, Count long, Name string").parquet(path)


# ---- report ----------------------------------------------------------------

@query
def q_top_rows_per_topic(spark, d):
    return _full(spark, d, R.top_rows_per_topic(_key_rows(spark, d)))


def _semi(spark, d) -> DataFrame:
    rows = _key_rows(spark, d)
    return R.semi_top_conversations(rows, R.top_rows_per_topic(rows))


@query
def q_semi_top_conversations(spark, d):
    return _full(spark, d, _semi(spark, d))


@query
def q_top_comments_per_conversation(spark, d):
    return _full(spark, d, R.top_comments_per_conversation(_semi(spark, d)))


@query
def q_dedupe_keep_first(spark, d):
    return _full(spark, d, R.dedupe_keep_first(_semi(spark, d)))


@query
def q_top_articles_by_likes(spark, d):
    """W1 by article (option): the articles of each topic with the most likes in total."""
    return R.top_articles_by_likes(_key_rows(spark, d))


@query
def q_top_comments(spark, d):
    """D3 + O1: the report rows in the report's order (Topic, conversation_id,
    conv_message_id, likes desc); a range-partitioned sort of <= 4 rows per
    conversation."""
    return R.display_order(_top(spark, d))


@query
def q_article_level_distinct(spark, d):
    return R.article_level_distinct(_top(spark, d))


@query
def q_hec_wide(spark, d):
    return R.hec_wide(_top(spark, d))


@query
def q_topic_report(spark, d):
    return R.topic_report(_top(spark, d))


@query
def q_topic_sheets(spark, d):
    return R.topic_sheets(spark, _top(spark, d))


@query
def q_sheets_union(spark, d):
    """Each sheet of a written report read as a frame of its own, then
    the union by column name (one sheet for each topic)."""
    path = scratch_path(spark, "topic_sheets")
    wide = R.hec_wide(_top(spark, d))
    write_topic_sheets(wide, path)
    names = [r[0] for r in read_topic_sheets(spark, path, wide.schema).select("sheet_name").distinct()
             .orderBy("sheet_name").collect()]
    sheets = [spark.read.schema(wide.schema).parquet(f"{path}/sheet_name={n}").withColumn("sheet_name", F.lit(n))
              for n in names]
    return union_sheets(sheets).select("sheet_name", "conversation_id", "Topic")


# ---- users -----------------------------------------------------------------

@query
def q_user_conversation_counts(spark, d):
    return U.user_conversation_counts(FX.comments_history(spark, d))


@query
def q_bucketed_user_counts(spark, d):
    """A5 from the counts of loads, a bucketed hand-off (here one load)."""
    loads = load_user_counts(FX.comments_history(spark, d), scratch_path(spark, "user_counts"), _buckets(spark))
    return user_counts_of_loads(loads)


@query
def q_top_conversations(spark, d):
    return U.top_conversations(FX.comments_history(spark, d))


@query
def q_user_conversation_rank(spark, d):
    return U.user_conversation_rank(FX.comments_history(spark, d))


@query
def q_convo_topic_map(spark, d):
    return U.convo_topic_map(_top_keys(spark, d))


@query
def q_top_topic_per_user(spark, d):
    return U.top_topic_per_user(FX.comments_history(spark, d), _top_keys(spark, d))


@query
def q_null_fractions(spark, d):
    return Q.null_fractions(U.top_topic_per_user(FX.comments_history(spark, d), _top_keys(spark, d)))


# ---- model comparison ------------------------------------------------------

@query
def q_compare_models(spark, d):
    return compare.compare_models(FX.doc_topic(spark, d), FX.doc_topic(spark, d, other_model=True),
                                  "main_model", "other_model")


@query
def q_topic_coverage(spark, d):
    return compare.topic_coverage(
        {"main_model": FX.doc_topic(spark, d), "other_model": FX.doc_topic(spark, d, other_model=True)},
        FX.articles(spark, d))


# ---- topic terms -----------------------------------------------------------

@query
def q_ctfidf_terms(spark, d):
    from threadlens.operators.terms import ctfidf_terms

    return ctfidf_terms(FX.doc_topic(spark, d))


@query
def q_topic_info(spark, d):
    from threadlens.operators.terms import topic_info

    return topic_info(FX.doc_topic(spark, d))


@query
def q_representative_documents(spark, d):
    """M9: the three documents of each topic that are most like it."""
    from threadlens.operators.terms import representative_docs

    return representative_docs(FX.doc_topic(spark, d))


# ---- neighbours and density clusters ----------------------------------------

# Fixed values (the reference's density settings): neighbours for the core
# distance, smallest cluster.
MIN_SAMPLES = 5
MIN_CLUSTER_SIZE = 5
# Own parameters: density level of the fixed-eps query, digits of distances.
DENSITY_EPS = 1.18
DIST_DIGITS = 6
# Own parameters of the k-means query: clusters and rounds.
KMEANS_K = 6
KMEANS_ROUNDS = 5
# Own parameter: recall that neighbour descent has to reach.
DESCENT_RECALL = 0.95


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query
def q_knn(spark, d):
    from threadlens.operators.neighbors import knn

    nn = knn(_points(spark, d), MIN_SAMPLES)
    return nn.select("id", "neighbor_id", F.round("distance", DIST_DIGITS).alias("distance"), "rank")


@query
def q_core_distance(spark, d):
    from threadlens.operators.neighbors import core_distance

    core = core_distance(_points(spark, d), MIN_SAMPLES)
    return core.select("id", F.round("core", DIST_DIGITS).alias("core"))


@query
def q_knn_descent(spark, d):
    """M3 approximate: the neighbours that descent finds for all points."""
    from threadlens.operators.descent import neighbor_descent

    nn = neighbor_descent(_points(spark, d), MIN_SAMPLES)
    return nn.select("id", "neighbor_id", F.round("distance", DIST_DIGITS).alias("distance"), "rank")


@query
def q_knn_descent_recall(spark, d):
    """M3: recall of descent against the exact search, over all given vectors
    and over the embedded texts of all documents."""
    from threadlens.operators.descent import neighbor_descent, recall
    from threadlens.operators.features import embed
    from threadlens.operators.neighbors import knn

    docs = embed(table(spark, d, "documents").select("doc_id", "text"), "text").select(
        F.col("doc_id").alias("id"), F.col("embedding").alias("vec"))
    out = None
    for name, points in (("embeddings", _points(spark, d)), ("documents", docs)):
        points = materialize(points, "recall-points")
        row = recall(neighbor_descent(points, MIN_SAMPLES), knn(points, MIN_SAMPLES), MIN_SAMPLES)
        row = row.select(F.lit(name).alias("source"), "links", (F.col("recall") >= DESCENT_RECALL).alias("reached"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def q_density_clusters(spark, d):
    from threadlens.operators.density import density_clusters

    return density_clusters(_points(spark, d), DENSITY_EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE)


@query
def q_kmeans_clusters(spark, d):
    """k-means of all given vectors, six clusters, at most five rounds."""
    from threadlens.operators.kmeans import dense_points, exact_kmeans, fixed_point

    vectors = table(spark, d, "embeddings")
    points = fixed_point(dense_points(vectors, "vec_id", "embedding", F.col("vec_id").cast("string")), "at", "vec")
    width = vectors.agg(F.max(F.size("embedding")).alias("w")).first()["w"]
    return exact_kmeans(materialize(points, "kmeans-points"), KMEANS_K, width, KMEANS_ROUNDS)


# ---- features and topic model -----------------------------------------------

@query
def q_join_embeddings(spark, d):
    from threadlens.operators.features import join_embeddings

    docs = table(spark, d, "documents").select("doc_id", "lang")
    return join_embeddings(docs, table(spark, d, "embeddings"))


@query
def q_embed_documents(spark, d):
    """F1 with the default batch embedder over whole document texts."""
    from threadlens.operators.features import embed

    return embed(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


@query
def q_embed_documents_stored(spark, d):
    """F1 with a caller's function and a store: first the documents that have a
    supplied vector, then all, of which only texts not yet stored are embedded."""
    from threadlens.operators.embedding_store import embed_stored, hashed_bag

    docs = table(spark, d, "documents").select("doc_id", "text")
    path = scratch_path(spark, "embedding_store")
    first = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    embed_stored(first, "text", path, "hashed-bag", hashed_bag)
    return embed_stored(docs, "text", path, "hashed-bag", hashed_bag).select("doc_id", "embedding", "embedding_error")


@query
def q_topic_reduce(spark, d):
    """M8 on the given doc_topic: merge to at most six topics besides -1."""
    from threadlens.plans.topics import N_TOPICS, topic_reduce

    return topic_reduce(FX.doc_topic(spark, d), N_TOPICS)


@query
def q_topic_model(spark, d):
    """Engaged descriptions → TF-IDF → PCA → density clusters chosen
    over all merge distances (outliers -1, dropped as M1 does) → at most 6 topics."""
    from threadlens.plans.topics import topic_model

    c, r, a, _ = _inputs(spark, d, url=False)
    doc_topic, _ = topic_model(E.engaged_descriptions(c, r, a), "description", clusterer="hierarchy")
    return doc_topic


@query
def q_topic_model_kmeans(spark, d):
    """M1 with the fast clusterer (F2): TF-IDF → k-means, 6 topics."""
    from threadlens.plans.topics import topic_model

    c, r, a, _ = _inputs(spark, d, url=False)
    doc_topic, _ = topic_model(E.engaged_descriptions(c, r, a), "description", clusterer="kmeans")
    return doc_topic


def _model_check(spark, d, clusterer: str) -> DataFrame:
    """What holds for any model of the engaged descriptions, exactly: each
    document once, at most six topics besides -1, summary equal to doc_topic."""
    from threadlens.plans.topics import N_TOPICS, topic_model

    c, r, a, _ = _inputs(spark, d, url=False)
    doc_topic, summary = topic_model(E.engaged_descriptions(c, r, a), "description", clusterer=clusterer,
                                     keep_outliers=True)
    doc_topic = materialize(doc_topic, "checked_doc_topic")
    counts = doc_topic.groupBy("Topic").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(summary, "Topic", "full").agg(
        F.count_if(F.coalesce(F.col("n") != F.col("Count"), F.lit(True))).alias("n_differing"),
        (F.count_if(F.col("Topic") >= 0) <= N_TOPICS).alias("few_topics"))
    return (doc_topic.agg(F.count(F.lit(1)).alias("n_documents"),
                          F.count_distinct(E.text_key("Document_description")).alias("n_distinct"))
            .withColumn("__one", F.lit(1)).join(both.withColumn("__one", F.lit(1)), "__one").drop("__one"))


@query
def q_topic_model_check(spark, d):
    return _model_check(spark, d, "hierarchy")


@query
def q_topic_model_density_check(spark, d):
    """one density level."""
    return _model_check(spark, d, "density")


@query
def q_topic_model_bisecting_check(spark, d):
    """bisecting k-means."""
    return _model_check(spark, d, "bisecting")


@query
def q_topic_model_embeddings(spark, d):
    """M2: documents with supplied embeddings, the others embedded here →
    density clusters with the outlier topic kept → at most 10 topics."""
    from threadlens.operators.features import join_embeddings
    from threadlens.plans.topics import topic_model

    docs = join_embeddings(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "embeddings"))
    doc_topic, _ = topic_model(docs, "text", n_topics=10, clusterer="hierarchy", features="embedding",
                               embedder=True, keep_outliers=True)
    return doc_topic


@query
def q_density_hierarchy(spark, d):
    """M6: clusters chosen over all merge distances by stability, and how
    firmly each point belongs to its cluster."""
    from threadlens.operators.density import density_hierarchy

    return density_hierarchy(_points(spark, d), MIN_SAMPLES, MIN_CLUSTER_SIZE, digits=DIST_DIGITS)


@query
def q_topic_probabilities(spark, d):
    """M2 with membership strengths: the documents with supplied embeddings,
    no topic merged, outliers kept."""
    from threadlens.plans.topics import topic_model

    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text").join(vectors, "doc_id")
    doc_topic, _ = topic_model(docs, "text", n_topics=docs.count(), clusterer="hierarchy", features="embedding",
                               keep_outliers=True, probabilities=True, digits=DIST_DIGITS)
    return doc_topic


@query
def q_modelled_topic_report(spark, d):
    """D8, the reference's intended main flow: topic model on the engaged
    descriptions (M11), its doc_topic into the report (D5)."""
    from threadlens.plans.topics import topic_model

    c, r, a, _ = _inputs(spark, d, url=False)
    doc_topic, _ = topic_model(E.engaged_descriptions(c, r, a), "description", clusterer="hierarchy")
    return R.topic_report(_top(spark, d, doc_topic))
