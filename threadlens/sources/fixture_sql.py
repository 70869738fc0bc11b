"""The fixture mapping of ``fixtures.py`` written as DuckDB SQL (common table
expressions over the given tables), used by the oracle queries."""

from __future__ import annotations


def _t(expr: str, name: str) -> str:
    return f"COALESCE(CAST({expr} AS VARCHAR), 'missing') AS {name}"


CONVERSATION = ("CASE WHEN event_id % 4 = 0 THEN 5 ELSE user_id * 7 "
                "+ CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 END")
LABEL = "COALESCE(e.label, d.doc_id % 10)"

CTES = {
    "comments": f"""comments AS (
  SELECT {_t(CONVERSATION, 'conversation_id')},
         {_t('event_id', 'conv_message_id')},
         {_t('user_id', 'author_id')},
         {_t("strftime(ts, '%Y-%m-%d %H:%M:%S')", 'written_date')},
         {_t('props', 'text_content')},
         {_t("CASE WHEN event_type = 'error' THEN 'blocked' ELSE event_type END", 'final_state')}
  FROM events)""",
    "reactions": f"""reactions AS (
  SELECT {_t('o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000000 ELSE 0 END', 'message_id')},
         {_t("printf('%.2f', o_totalprice)", 'total_views')},
         {_t("CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE CAST(o_custkey % 500 AS VARCHAR) END", 'total_likes')}
  FROM orders)""",
    "articles": f"""articles AS (
  SELECT {_t("source || '/' || CAST(doc_id AS VARCHAR)", 'title')},
         'missing' AS published_date,
         {_t('text', 'description')},
         {_t('url', 'canonical_url')},
         {_t('doc_id + CASE WHEN doc_id % 10 = 9 THEN 1000000000 ELSE 0 END', 'conversation_id')},
         'missing' AS thumbnail_url
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)""",
    "doc_topic": f"""doc_topic AS (
  SELECT CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INTEGER) AS Topic, text AS Document_description
  FROM (SELECT d.text, arg_min({LABEL}, d.doc_id) AS label
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.text))""",
    "doc_topic_other": f"""doc_topic_other AS (
  SELECT CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INTEGER) AS Topic, text AS Document_description
  FROM (SELECT d.text, arg_min(CASE WHEN d.doc_id % 2 = 0 THEN ({LABEL} + 3) % 10 ELSE {LABEL} END, d.doc_id) AS label
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.text))""",
    "comments_history": f"""comments_history AS (
  SELECT {_t('user_id', 'user_id')},
         {_t(f"{CONVERSATION} + CASE WHEN user_id % 3 = 0 THEN 1000000000 ELSE 0 END", 'conversation_id')},
         {_t('event_id', 'message_id')}
  FROM events)""",
}


def with_ctes(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause with the named fixture tables, then extra CTEs, then body."""
    parts = [CTES[n] for n in names] + list(extra or [])
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
