"""DuckDB SQL equal to each query in ``catalog.py`` (same column names and
types), over the given tables; the fixture tables are common table
expressions from ``sources/fixture_sql.py``."""

from __future__ import annotations

from threadlens.sources.fixture_sql import with_ctes

ORACLE: dict[str, str] = {}

_COUNT = "CAST(round_even(CAST(COALESCE(NULLIF({c}, 'missing'), '0') AS DOUBLE), 0) AS BIGINT)"

COMMENTS_NB = "comments_nb AS (SELECT * FROM comments WHERE final_state <> 'blocked')"

JOINED_OUTER = """joined AS (
  SELECT c.conversation_id, c.conv_message_id, c.author_id, c.written_date, c.text_content,
         c.final_state, r.message_id, r.total_views, r.total_likes,
         a.title, a.published_date, a.description, a.canonical_url, a.thumbnail_url,
         dt.Topic, dt.Document_description
  FROM comments_nb c RIGHT JOIN reactions r ON c.conv_message_id = r.message_id
  LEFT JOIN articles a ON a.conversation_id = c.conversation_id
  LEFT JOIN doc_topic dt ON a.description = dt.Document_description)"""

COMPILED = f"""compiled AS (
  SELECT title, description, published_date, canonical_url, thumbnail_url,
         CAST(COALESCE(Topic, -1) AS INTEGER) AS Topic, written_date, conversation_id,
         conv_message_id, author_id, text_content, final_state, message_id,
         {_COUNT.format(c='total_views')} AS total_views,
         {_COUNT.format(c='total_likes')} AS total_likes
  FROM joined WHERE COALESCE(Topic, -1) >= 0)"""

TOP_ROWS = """top_rows AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY Topic ORDER BY total_likes DESC, length(message_id), message_id,
           title, conversation_id, conv_message_id, description) AS rn FROM compiled) WHERE rn <= 10)"""

SEMI = """semi_rows AS (
  SELECT * FROM compiled WHERE conversation_id IS NOT NULL
    AND conversation_id IN (SELECT conversation_id FROM top_rows))"""

TOP4 = """top4 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY total_likes DESC, length(message_id),
           message_id, Topic, title, conv_message_id, description) AS rn FROM semi_rows) WHERE rn <= 4)"""


def _dedupe(src: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id, conv_message_id ORDER BY Topic,
           total_likes DESC, title, description, message_id) AS rn FROM {src}) WHERE rn = 1"""


TOP_COMMENTS = f"top_comments AS ({_dedupe('top4')})"

BASE = ["comments", "reactions", "articles", "doc_topic"]
REPORT_CTES = [COMMENTS_NB, JOINED_OUTER, COMPILED, TOP_ROWS, SEMI, TOP4, TOP_COMMENTS]

ARTICLE_LEVEL = ["title", "description", "published_date", "canonical_url", "thumbnail_url",
                 "Topic", "conversation_id"]
SLOT_COLS = ["conv_message_id", "author_id", "text_content", "final_state", "message_id",
             "total_views", "total_likes", "written_date"]


def _wide_select() -> str:
    slots = ",\n         ".join(
        f"max(CASE WHEN slot = {n} THEN {c} END) AS HEC{n}_{c}"
        for n in range(1, 5) for c in SLOT_COLS)
    keys = ", ".join(ARTICLE_LEVEL)
    return f"""SELECT {keys},
         {slots}
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY conv_message_id) AS slot
        FROM top_comments)
  GROUP BY {keys}"""


HEC_WIDE = f"hec AS ({_wide_select()})"
SHEET_NAME = "substr(trim(CAST(Topic AS VARCHAR)), 1, 31)"


def _q(name: str, tables: list[str], body: str, extra: list[str] | None = None) -> None:
    ORACLE[name] = with_ctes(tables, body, extra)


_q("read_cols", ["articles"], "SELECT * FROM articles")
_q("strip_non_ascii", [], "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F#&;]+', '', 'g') AS text FROM documents")
_q("filter_blocked", ["comments"], "SELECT * FROM comments WHERE final_state <> 'blocked'")
_q("blocked_count", ["comments"],
   "SELECT count(*) FILTER (WHERE final_state = 'blocked') AS n_blocked, count(*) AS n_comments FROM comments")
_q("distinct_counts", ["comments", "articles"], """
SELECT 'comments' AS source, 'conversation_id' AS column_name, count(DISTINCT conversation_id) AS n_distinct FROM comments
UNION ALL SELECT 'articles', 'title', count(DISTINCT title) FROM articles
UNION ALL SELECT 'articles', 'description', count(DISTINCT description) FROM articles""")
_q("distinct_counts_by_month", ["comments"], "\nUNION ALL ".join(
    f"""SELECT substr(written_date, 1, 7) AS month, '{c}' AS column_name, count(DISTINCT {c}) AS n_exact,
  TRUE AS within_error FROM comments GROUP BY substr(written_date, 1, 7)""" for c in ("conversation_id", "author_id")))
_q("clean_counts", ["reactions"], f"""SELECT message_id, {_COUNT.format(c='total_views')} AS total_views,
  {_COUNT.format(c='total_likes')} AS total_likes FROM reactions""")

_q("comments_reactions_left", ["comments", "reactions"], """
SELECT c.*, r.* FROM comments_nb c LEFT JOIN reactions r ON c.conv_message_id = r.message_id""", [COMMENTS_NB])
_q("comments_articles_left", ["comments", "reactions", "articles"], """
SELECT c.*, r.*, a.title, a.published_date, a.description, a.canonical_url, a.thumbnail_url
FROM comments_nb c LEFT JOIN reactions r ON c.conv_message_id = r.message_id
LEFT JOIN articles a ON a.conversation_id = c.conversation_id""", [COMMENTS_NB])
_q("engaged_descriptions", ["comments", "reactions", "articles"], """
SELECT DISTINCT a.description
FROM comments_nb c LEFT JOIN reactions r ON c.conv_message_id = r.message_id
LEFT JOIN articles a ON a.conversation_id = c.conversation_id
WHERE r.message_id IS NOT NULL AND a.conversation_id IS NOT NULL""", [COMMENTS_NB])
_q("reactions_right_join", ["comments", "reactions"], """
SELECT c.*, r.* FROM comments_nb c RIGHT JOIN reactions r ON c.conv_message_id = r.message_id""", [COMMENTS_NB])
ORACLE["bucketed_left_join"] = ORACLE["comments_reactions_left"]
ORACLE["bucketed_right_join"] = ORACLE["reactions_right_join"]
_q("description_topic_join", ["articles", "doc_topic"], """
SELECT a.*, dt.Topic, dt.Document_description FROM articles a
LEFT JOIN doc_topic dt ON a.description = dt.Document_description""")
_q("compile_engagement", BASE, "SELECT * FROM compiled", [COMMENTS_NB, JOINED_OUTER, COMPILED])
_q("key_overlap", ["comments", "reactions", "articles", "doc_topic"], """
SELECT 'message_id' AS pair, count(*) AS overlap FROM (SELECT conv_message_id FROM comments_nb INTERSECT SELECT message_id FROM reactions)
UNION ALL SELECT 'conversation_id', count(*) FROM (SELECT conversation_id FROM comments_nb INTERSECT SELECT conversation_id FROM articles)
UNION ALL SELECT 'description', count(*) FROM (SELECT description FROM articles INTERSECT SELECT Document_description FROM doc_topic)""",
   [COMMENTS_NB])

_q("missing_topic_stats", BASE, """
SELECT count(*) FILTER (WHERE COALESCE(Topic, -1) = -1) AS n_missing_topic, count(*) AS n_rows FROM joined""",
   [COMMENTS_NB, JOINED_OUTER])
_q("null_counts", ["doc_topic"], """
SELECT 'Topic' AS column_name, count(*) FILTER (WHERE Topic IS NULL) AS n_null FROM doc_topic
UNION ALL SELECT 'Document_description', count(*) FILTER (WHERE Document_description IS NULL) FROM doc_topic""")
_q("duplicate_rows", ["doc_topic"], """
SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS n FROM doc_topic GROUP BY Topic, Document_description)""")
_q("compiled_uniqueness", BASE, """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, sum(n) = count(*) AS is_unique
FROM (SELECT count(*) AS n FROM compiled GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY " + ", ".join([
    "title", "description", "published_date", "canonical_url", "thumbnail_url", "Topic", "written_date",
    "conversation_id", "conv_message_id", "author_id", "text_content", "final_state", "message_id", "total_views",
    "total_likes"])), [COMMENTS_NB, JOINED_OUTER, COMPILED])
_q("topic_column_check", BASE, """
SELECT 'compiled' AS source, count(*) AS n_rows, true AS has_topic FROM compiled
UNION ALL SELECT 'comments', count(*), false FROM comments_nb""", [COMMENTS_NB, JOINED_OUTER, COMPILED])

_q("drop_outliers", ["doc_topic"], "SELECT * FROM doc_topic WHERE Topic <> -1")
_q("topic_counts", ["doc_topic"], "SELECT Topic, count(*) AS Count FROM doc_topic GROUP BY Topic ORDER BY Topic")
_q("preview_topics", ["doc_topic"], "SELECT * FROM doc_topic ORDER BY Topic, Document_description LIMIT 5")
_q("doc_topic_scan", ["doc_topic"], "SELECT * FROM doc_topic")

_q("top_rows_per_topic", BASE, "SELECT * FROM top_rows", REPORT_CTES[:4])
_q("semi_top_conversations", BASE, "SELECT * FROM semi_rows", REPORT_CTES[:5])
_q("top_comments_per_conversation", BASE, "SELECT * FROM top4", REPORT_CTES[:6])
_q("dedupe_keep_first", BASE, _dedupe("semi_rows"), REPORT_CTES[:5])
_q("top_articles_by_likes", BASE, """
SELECT Topic, conversation_id, total_likes FROM (
  SELECT *, row_number() OVER (PARTITION BY Topic ORDER BY total_likes DESC, conversation_id) AS rn FROM (
    SELECT Topic, conversation_id, CAST(sum(total_likes) AS BIGINT) AS total_likes FROM compiled
    GROUP BY Topic, conversation_id)) WHERE rn <= 10""", [COMMENTS_NB, JOINED_OUTER, COMPILED])
_q("top_comments", BASE, "SELECT * FROM top_comments", REPORT_CTES)
_q("article_level_distinct", BASE, f"SELECT DISTINCT {', '.join(ARTICLE_LEVEL)} FROM top_comments", REPORT_CTES)
_q("hec_wide", BASE, "SELECT * FROM hec", REPORT_CTES + [HEC_WIDE])
_q("topic_report", BASE, f"SELECT *, {SHEET_NAME} AS sheet_name FROM hec", REPORT_CTES + [HEC_WIDE])
_q("topic_sheets", BASE, f"SELECT *, {SHEET_NAME} AS sheet_name FROM hec", REPORT_CTES + [HEC_WIDE])
_q("sheets_union", BASE, f"SELECT {SHEET_NAME} AS sheet_name, conversation_id, Topic FROM hec",
   REPORT_CTES + [HEC_WIDE])

COUNTS = """counts AS (
  SELECT user_id, conversation_id, count(*) AS "count" FROM comments_history GROUP BY user_id, conversation_id)"""
RANKED = """ranked AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY "count" DESC) AS INTEGER) AS "rank" FROM counts)"""
TOPIC_MAP = """topic_map AS (
  SELECT conversation_id, max(Topic) AS topic FROM top_comments WHERE conversation_id IS NOT NULL GROUP BY conversation_id)"""
BEST = """per_user AS (
  SELECT u.user_id, b.conversation_id, b."count", b."rank", b.topic
  FROM (SELECT DISTINCT user_id FROM counts) u
  LEFT JOIN (SELECT * EXCLUDE (rn) FROM (
      SELECT r.*, m.topic, row_number() OVER (PARTITION BY r.user_id ORDER BY r."count" DESC, r.conversation_id) AS rn
      FROM ranked r JOIN topic_map m USING (conversation_id)) WHERE rn = 1) b USING (user_id))"""
USERS = BASE + ["comments_history"]

_q("user_conversation_counts", ["comments_history"], "SELECT * FROM counts", [COUNTS])
ORACLE["bucketed_user_counts"] = ORACLE["user_conversation_counts"]
_q("top_conversations", ["comments_history"],
   'SELECT * FROM counts ORDER BY "count" DESC, user_id, conversation_id', [COUNTS])
_q("user_conversation_rank", ["comments_history"], "SELECT * FROM ranked", [COUNTS, RANKED])
_q("convo_topic_map", BASE, "SELECT * FROM topic_map", REPORT_CTES + [TOPIC_MAP])
_q("top_topic_per_user", USERS, "SELECT * FROM per_user", REPORT_CTES + [COUNTS, RANKED, TOPIC_MAP, BEST])
_q("null_fractions", USERS, "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {q} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_fraction FROM per_user"
    for c, q in [("user_id", "user_id"), ("conversation_id", "conversation_id"), ("count", '"count"'),
                 ("rank", '"rank"'), ("topic", "topic")]),
   REPORT_CTES + [COUNTS, RANKED, TOPIC_MAP, BEST])

_q("compare_models", ["doc_topic", "doc_topic_other"], """
SELECT COALESCE(a.position, b.position) AS position, a.main_model, b.other_model FROM
  (SELECT row_number() OVER (ORDER BY Document_description, Topic) AS position, Document_description AS main_model FROM doc_topic) a
  FULL JOIN
  (SELECT row_number() OVER (ORDER BY Document_description, Topic) AS position, Document_description AS other_model FROM doc_topic_other) b
  ON a.position = b.position""")
_q("topic_coverage", ["doc_topic", "doc_topic_other", "articles"], """
SELECT 'main_model' AS model, count(*) AS n_articles_with_topic FROM articles a JOIN doc_topic t ON t.Document_description = a.description
UNION ALL
SELECT 'other_model', count(*) FROM articles a JOIN doc_topic_other t ON t.Document_description = a.description""")

# ---- topic terms -------------------------------------------------------------

CTFIDF = [
    r"""toks AS (SELECT Topic, unnest(string_split_regex(lower(Document_description), '[^\p{L}\p{N}]+')) AS term
  FROM doc_topic)""",
    "tf AS (SELECT Topic, term, count(*) AS tf FROM toks WHERE length(term) >= 2 GROUP BY Topic, term)",
    "tt AS (SELECT Topic, sum(tf) AS n_topic FROM tf GROUP BY Topic)",
    "tt2 AS (SELECT Topic, n_topic, floor(avg(n_topic) OVER ()) AS avg_tokens FROM tt)",
    "wt AS (SELECT term, sum(tf) AS n_term FROM tf GROUP BY term)",
    """weights AS (SELECT tf.Topic, tf.term,
  round((CAST(tf.tf AS DOUBLE) / tt2.n_topic) * ln(1 + CAST(tt2.avg_tokens AS DOUBLE) / wt.n_term), 6) AS weight
  FROM tf JOIN tt2 USING (Topic) JOIN wt USING (term))""",
    """ranked_terms AS (SELECT Topic, term, weight,
  CAST(row_number() OVER (PARTITION BY Topic ORDER BY weight DESC, term) AS INTEGER) AS "rank" FROM weights)""",
]
_q("ctfidf_terms", ["doc_topic"], 'SELECT * FROM ranked_terms WHERE "rank" <= 10', CTFIDF)
_q("topic_info", ["doc_topic"], """
SELECT c.Topic, c.Count, CAST(c.Topic AS VARCHAR) || '_' || COALESCE(n.words, '') AS Name
FROM (SELECT Topic, count(*) AS Count FROM doc_topic GROUP BY Topic) c
LEFT JOIN (SELECT Topic, string_agg(term, '_' ORDER BY "rank") AS words FROM ranked_terms WHERE "rank" <= 4 GROUP BY Topic) n
  USING (Topic)
WHERE c.Count > 0 AND c.Topic <> -1""", CTFIDF)

_q("representative_documents", ["doc_topic"], """
SELECT Topic, "rank", Document_description, score FROM (
  SELECT Topic, Document_description, score, CAST(row_number() OVER (PARTITION BY Topic ORDER BY score DESC,
         sha256(Document_description)) AS INTEGER) AS "rank"
  FROM (SELECT d.Topic, Document_description, round(coalesce(dot / (norm * topic_norm), 0.0), 6) AS score
        FROM doc_topic d LEFT JOIN doc_sums USING (Document_description) LEFT JOIN topic_norms ON topic_norms.Topic = d.Topic
        WHERE d.Topic <> -1 AND Document_description IS NOT NULL)) WHERE "rank" <= 3""", CTFIDF[:5] + [
    """full_weights AS (SELECT tf.Topic, tf.term, ln(1 + CAST(tt2.avg_tokens AS DOUBLE) / wt.n_term) AS idf,
  (CAST(tf.tf AS DOUBLE) / tt2.n_topic) * ln(1 + CAST(tt2.avg_tokens AS DOUBLE) / wt.n_term) AS w
  FROM tf JOIN tt2 USING (Topic) JOIN wt USING (term))""",
    "topic_norms AS (SELECT Topic, sqrt(sum(w * w)) AS topic_norm FROM full_weights GROUP BY Topic)",
    r"""doc_terms AS (SELECT Topic, Document_description, term, count(*) AS n FROM (
    SELECT Topic, Document_description, unnest(string_split_regex(lower(Document_description), '[^\p{L}\p{N}]+')) AS term
    FROM doc_topic) WHERE length(term) >= 2 GROUP BY Topic, Document_description, term)""",
    """doc_sums AS (SELECT Document_description, sum(n * idf * w) AS dot, sqrt(sum((n * idf) * (n * idf))) AS norm
  FROM doc_terms JOIN full_weights USING (Topic, term) GROUP BY Document_description)"""])

ORACLE["topic_summary_scan"] = ORACLE["topic_info"]

# ---- neighbours and density clusters --------------------------------------------

PAIRS = """pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
dists AS (SELECT a.id, b.id AS neighbor_id, list_distance(a.vec, b.vec) AS distance
          FROM pts a JOIN pts b ON a.id <> b.id),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) AS INTEGER) AS "rank"
       FROM dists)"""
ORACLE["knn"] = f"""WITH {PAIRS}
SELECT id, neighbor_id, round(distance, 6) AS distance, "rank" FROM nn WHERE "rank" <= 5"""
ORACLE["core_distance"] = f"""WITH {PAIRS}
SELECT id, round(distance, 6) AS core FROM nn WHERE "rank" = 5"""
ORACLE["knn_descent_recall"] = """
SELECT 'embeddings' AS source, 5 * count(*) AS links, TRUE AS reached FROM embeddings
UNION ALL SELECT 'documents', 5 * count(*), TRUE FROM documents"""
ORACLE["density_clusters"] = f"""WITH RECURSIVE {PAIRS},
core_pts AS (SELECT id FROM nn WHERE "rank" = 5 AND distance <= 1.18),
links AS (SELECT d.id AS a, d.neighbor_id AS b FROM dists d
          JOIN core_pts c1 ON d.id = c1.id JOIN core_pts c2 ON d.neighbor_id = c2.id
          WHERE d.distance <= 1.18),
reach(a, b) AS (SELECT id, id FROM core_pts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY component)
SELECT p.id, CAST(CASE WHEN s.n >= 5 THEN c.component ELSE -1 END AS BIGINT) AS cluster
FROM pts p LEFT JOIN comp c ON p.id = c.id LEFT JOIN sizes s ON c.component = s.component"""

def hierarchy_sql(points: str, min_samples: int, min_size: int, digits: int) -> str:
    """M6 from all pairs: CTEs that end in hdb (id, cluster, probability), for
    a relation pts (id, vec) given by ``points``. Prim's order of the points
    (prim, picked) makes every component at a distance a stretch of places that
    no larger step interrupts."""
    return f"""pts AS (SELECT id, vec FROM ({points})),
dists AS (SELECT a.id, b.id AS other, list_distance(a.vec, b.vec) AS distance FROM pts a JOIN pts b ON a.id <> b.id),
core AS (SELECT id, distance AS core FROM dists
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, other) = {min_samples}),
reach AS MATERIALIZED (SELECT d.id AS a, d.other AS b, round(greatest(d.distance, x.core, y.core), {digits}) AS w
         FROM dists d JOIN core x ON d.id = x.id JOIN core y ON d.other = y.id),
prim(step, i, best, pick, pick_w) AS (
  SELECT 1, b, w, first_value(b) OVER o, first_value(w) OVER o FROM reach WHERE a = (SELECT min(id) FROM core)
  WINDOW o AS (ORDER BY w, b)
  UNION ALL
  SELECT step, i, best, first_value(i) OVER o, first_value(best) OVER o FROM (
    SELECT p.step + 1 AS step, p.i, least(p.best, r.w) AS best FROM prim p JOIN reach r ON r.a = p.pick AND r.b = p.i
    WHERE p.i <> p.pick) WINDOW o AS (ORDER BY best, i)),
picked AS MATERIALIZED (SELECT 0 AS pos, min(id) AS id, CAST(NULL AS DOUBLE) AS w FROM core
  UNION ALL SELECT DISTINCT step, pick, pick_w FROM prim),
least_w AS (SELECT coalesce(min(w) FILTER (w > 0), 1.0) AS floor_w, max(pos) AS last FROM picked),
stretches AS MATERIALIZED (SELECT DISTINCT k.w, coalesce(max(j.pos) FILTER (j.pos < k.pos), 0) AS l,
    coalesce(min(j.pos) FILTER (j.pos > k.pos) - 1, any_value(last)) AS r
  FROM picked k CROSS JOIN least_w LEFT JOIN picked j ON j.w > k.w WHERE k.w IS NOT NULL GROUP BY k.pos, k.w),
nodes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r - l, l) AS n, l, r, w, r - l + 1 AS size,
    CAST(round(1000000.0 / greatest(w, floor_w)) AS BIGINT) AS lam FROM stretches, least_w WHERE r - l + 1 >= {min_size}),
up AS MATERIALIZED (SELECT c.n, min(p.n) AS p FROM nodes c JOIN nodes p ON p.l <= c.l AND p.r >= c.r AND p.size > c.size GROUP BY c.n),
kids AS (SELECT p AS n, count(*) AS k, sum(size) AS inner_size FROM up JOIN nodes USING (n) GROUP BY p),
heads AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n) AS h, n, l, r, size, p, coalesce(b.lam, 0) AS born
  FROM nodes LEFT JOIN up USING (n) LEFT JOIN (SELECT n AS p, k FROM kids) q USING (p)
  LEFT JOIN (SELECT n AS p, lam FROM nodes) b USING (p) WHERE p IS NULL OR q.k >= 2),
head_of AS MATERIALIZED (SELECT x.n, min(h) AS h FROM nodes x JOIN heads y ON y.l <= x.l AND y.r >= x.r GROUP BY x.n),
left_at AS (SELECT h, sum((size - coalesce(inner_size, 0)) * lam) AS s, max(lam) AS largest
  FROM nodes JOIN head_of USING (n) LEFT JOIN kids USING (n) GROUP BY h),
passed AS (SELECT o.h, sum(y.size * y.born) AS s, list(y.h) AS below FROM heads y JOIN head_of o ON o.n = y.p GROUP BY o.h),
tree AS MATERIALIZED (SELECT heads.h, l, r, largest, coalesce(below, []) AS below, CAST(CASE WHEN p IS NULL THEN 0 ELSE
    greatest(0, left_at.s + coalesce(passed.s, 0) - size * born) END AS BIGINT) AS own
  FROM heads JOIN left_at ON left_at.h = heads.h LEFT JOIN passed ON passed.h = heads.h),
mass(h, best, keep) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BOOLEAN[])
  UNION ALL
  SELECT h, list_append(best, greatest(own, below_sum)), list_append(keep, own > 0 AND own >= below_sum) FROM (
    SELECT t.h, m.best, m.keep, t.own, CAST(coalesce(list_sum(list_select(m.best, t.below)), 0) AS BIGINT) AS below_sum
    FROM mass m JOIN tree t ON t.h = m.h + 1)),
kept AS (SELECT t.* FROM tree t, (SELECT keep FROM mass ORDER BY h DESC LIMIT 1) m WHERE m.keep[t.h]),
places AS (SELECT pos, id, min(n) AS n FROM picked JOIN nodes ON pos BETWEEN l AND r GROUP BY pos, id),
chosen AS (SELECT p.id, p.n, max(k.h) AS h FROM places p JOIN kept k ON p.pos BETWEEN k.l AND k.r GROUP BY p.id, p.n),
names AS (SELECT h, largest, min(id) AS cluster FROM kept JOIN picked ON pos BETWEEN l AND r GROUP BY h, largest),
hdb AS (SELECT pts.id, coalesce(cluster, -1) AS cluster, coalesce(least(lam, largest) / largest, 0.0) AS probability
  FROM pts LEFT JOIN chosen USING (id) LEFT JOIN nodes USING (n) LEFT JOIN names ON names.h = chosen.h)"""


ORACLE["density_hierarchy"] = f"""WITH RECURSIVE {hierarchy_sql(
    "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings", 5, 5, 6)}
SELECT id, CAST(cluster AS BIGINT) AS cluster, probability FROM hdb"""
_EMBEDDED = "SELECT text, min(embedding) AS vec FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY text"
ORACLE["topic_probabilities"] = f"""WITH RECURSIVE {hierarchy_sql(
    f"SELECT row_number() OVER (ORDER BY text) AS id, CAST(vec AS DOUBLE[]) AS vec FROM ({_EMBEDDED})", 5, 5, 6)},
texts AS (SELECT row_number() OVER (ORDER BY text) AS id, text FROM ({_EMBEDDED})),
sized AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, min(text)) - 1 AS topic
  FROM hdb JOIN texts USING (id) WHERE cluster <> -1 GROUP BY cluster)
SELECT CAST(coalesce(topic, -1) AS INTEGER) AS Topic, text AS Document_description, probability
FROM hdb JOIN texts USING (id) LEFT JOIN sized USING (cluster)"""
ORACLE["join_embeddings"] = """SELECT d.doc_id, d.lang, e.embedding, e.label
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
ORACLE["embed_documents"] = r"""
WITH t AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h
           FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM documents)
           WHERE length(term) >= 2),
b AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM t GROUP BY doc_id, h % 64),
g AS (SELECT d.doc_id, r.i, coalesce(b.s, 0) AS s
      FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS i) r
      LEFT JOIN b ON b.doc_id = d.doc_id AND b.i = r.i),
n AS (SELECT doc_id, sqrt(CAST(sum(s * s) AS DOUBLE)) AS norm FROM g GROUP BY doc_id)
SELECT doc_id, list(CAST(CASE WHEN norm > 0 THEN s / norm ELSE 0 END AS FLOAT) ORDER BY i) AS embedding
FROM g JOIN n USING (doc_id) GROUP BY doc_id"""

ORACLE["embed_documents_stored"] = f"SELECT *, CAST(NULL AS VARCHAR) AS embedding_error FROM ({ORACLE['embed_documents']})"


def _kmeans_sql(k: int, rounds: int) -> str:
    """k-means in whole numbers with its seeds and rounds written out (a round
    in which no centre moves changes nothing, so ending early is the same)."""
    ctes = ["""raw AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS f FROM embeddings)""",
            """pts AS MATERIALIZED (SELECT id, f, CAST(floor(CAST(x AS DOUBLE) * s + 0.5) AS BIGINT) AS x FROM raw,
  (SELECT power(2, 20 - ceil(log2(max(abs(CAST(x AS DOUBLE)))))) AS s FROM raw))"""]

    def u(i):
        return f"(CAST('0x' || substr(md5('{i}:' || id), 1, 8) AS BIGINT) + 1.0) / 4294967296.0"

    for i in range(k):
        if i == 0:
            time = f"SELECT id, -ln({u(i)}) AS t FROM (SELECT DISTINCT id FROM pts)"
        else:
            far = " UNION ALL ".join(f"SELECT p.id, sum((p.x - c.x) * (p.x - c.x)) AS d FROM pts p JOIN pts c USING (f), "
                                     f"seed{j} WHERE c.id = seed{j}.id GROUP BY p.id" for j in range(i))
            time = (f"SELECT id, -ln({u(i)}) / CAST(d AS DOUBLE) AS t FROM (SELECT id, min(d) AS d FROM ({far}) GROUP BY id) "
                    "WHERE d > 0")
        ctes.append(f"seed{i} AS MATERIALIZED (SELECT id FROM ({time}) ORDER BY t, CAST(id AS VARCHAR) LIMIT 1)")
    ctes.append("c0 AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {i} AS label, f, x FROM pts JOIN seed{i} USING (id)" for i in range(k)) + ")")
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT id, label FROM (
  SELECT p.id, c.label, sum((p.x - c.x) * (p.x - c.x)) AS d FROM pts p JOIN c{r} c USING (f) GROUP BY p.id, c.label)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, label) = 1)""")
        ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.label, c.f, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT label, f, CAST(floor(CAST(2 * sum(x) + count(*) AS DOUBLE) / (2 * count(*))) AS BIGINT) AS x
  FROM pts JOIN a{r} USING (id) GROUP BY label, f) m USING (label, f))""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id, CAST(label AS INTEGER) AS label FROM a{rounds}"


ORACLE["kmeans_clusters"] = _kmeans_sql(k=6, rounds=5)


def _reduce_sql(merges: int, n_topics: int) -> str:
    """M8 with its rounds written out: ``merges`` of them, each only while
    more than ``n_topics`` topics remain."""
    ctes = [CTFIDF[0], "raw AS MATERIALIZED (SELECT Topic, term, count(*) AS tf FROM toks WHERE length(term) >= 2 GROUP BY Topic, term)",
            "docs AS (SELECT Topic, count(*) AS n FROM doc_topic GROUP BY Topic)",
            "m0 AS (SELECT Topic AS o, Topic AS c FROM docs)"]
    for i in range(merges):
        ctes += [
            f"sz{i} AS MATERIALIZED (SELECT c, sum(n) AS n FROM m{i} JOIN docs ON o = Topic WHERE c <> -1 GROUP BY c)",
            f"sm{i} AS MATERIALIZED (SELECT c AS s FROM sz{i} ORDER BY n, c DESC LIMIT 1)",
            f"tf{i} AS MATERIALIZED (SELECT c, term, sum(tf) AS tf FROM raw JOIN m{i} ON Topic = o GROUP BY c, term)",
            f"tot{i} AS (SELECT c, sum(tf) AS n_topic FROM tf{i} GROUP BY c)",
            f"avg{i} AS (SELECT floor(avg(n_topic)) AS a FROM tot{i})",
            f"term{i} AS (SELECT term, sum(tf) AS n_term FROM tf{i} GROUP BY term)",
            f"""w{i} AS MATERIALIZED (SELECT tf{i}.c, term, round((CAST(tf{i}.tf AS DOUBLE) / n_topic)
                * ln(1 + CAST(a AS DOUBLE) / n_term), 12) AS w FROM tf{i} JOIN tot{i} USING (c) JOIN term{i} USING (term), avg{i})""",
            f"""sim{i} AS (SELECT x.c, round(sum(x.w * coalesce(y.w, 0)) / sqrt(sum(x.w * x.w)), 12) AS sim
                FROM w{i} x LEFT JOIN (SELECT term, w FROM w{i}, sm{i} WHERE c = s) y USING (term)
                GROUP BY x.c HAVING sum(x.w * x.w) > 0)""",
            f"""to{i} AS MATERIALIZED (SELECT c AS t FROM sz{i} LEFT JOIN sim{i} USING (c), sm{i} WHERE c <> s
                ORDER BY coalesce(sim, 0) DESC, c LIMIT 1)""",
            f"""m{i + 1} AS MATERIALIZED (SELECT o, CASE WHEN c = s AND (SELECT count(*) FROM sz{i}) > {n_topics}
                THEN t ELSE c END AS c FROM m{i}, sm{i}, to{i})""",
        ]
    return with_ctes(["doc_topic"], f"""SELECT CAST(c AS INTEGER) AS Topic, Document_description
FROM doc_topic JOIN m{merges} ON o = Topic""", ctes)


ORACLE["topic_reduce"] = _reduce_sql(merges=3, n_topics=6)

for _name in ("topic_model_check", "topic_model_density_check", "topic_model_bisecting_check"):
    _q(_name, ["comments", "reactions", "articles"], """
SELECT count(*) AS n_documents, count(*) AS n_distinct, CAST(0 AS BIGINT) AS n_differing, true AS few_topics FROM (
  SELECT DISTINCT a.description
  FROM comments_nb c JOIN reactions r ON c.conv_message_id = r.message_id
  JOIN articles a ON a.conversation_id = c.conversation_id)""", [COMMENTS_NB])
