"""The relational jobs against plain Python over row dictionaries: what SURVEY
§1.5 and §2 say about each result, worked out row by row from the inputs."""

from collections import Counter, defaultdict

import pytest

from conftest import SF_SMALL
from threadlens.plans import engagement as E, report as R, users as U
from threadlens.sources import fixtures as FX


@pytest.fixture(scope="module")
def frames(spark):
    return (FX.comments(spark, SF_SMALL), FX.reactions(spark, SF_SMALL), FX.articles(spark, SF_SMALL),
            FX.doc_topic(spark, SF_SMALL))


@pytest.fixture(scope="module")
def rows(frames):
    return [[r.asDict() for r in f.collect()] for f in frames]


def count_of(text):
    """'missing' is 0; halves go to the even neighbour."""
    return 0 if text == "missing" else round(float(text))


def expected_compiled(rows):
    """One row for each (open comment, reaction, article, topic >= 0) that belong together."""
    comments, reactions, articles, topics = rows
    topic_of = {t["Document_description"]: t["Topic"] for t in topics}
    reacts, about = defaultdict(list), defaultdict(list)
    for r in reactions:
        reacts[r["message_id"]].append(r)
    for a in articles:
        about[a["conversation_id"]].append(a)
    out = []
    for c in comments:
        if c["final_state"] == "blocked":
            continue
        for r in reacts[c["conv_message_id"]]:
            for a in about[c["conversation_id"]]:
                if topic_of.get(a["description"], -1) >= 0:
                    out.append({**a, **c, "Topic": topic_of[a["description"]], "message_id": r["message_id"],
                                "total_views": count_of(r["total_views"]), "total_likes": count_of(r["total_likes"])})
    return out


def as_set(rows):
    return sorted(tuple(str(r[c]) for c in E.COMPILED_COLS) for r in rows)


def test_compiled_rows(frames, rows):
    got = [r.asDict() for r in E.compile_engagement(*frames).collect()]
    want = expected_compiled(rows)
    assert as_set(got) == as_set(want) and len(want) > 100


def test_engaged_descriptions(frames, rows):
    comments, reactions, articles, _ = rows
    reacted = {r["message_id"] for r in reactions}
    alive = {c["conversation_id"] for c in comments if c["final_state"] != "blocked" and c["conv_message_id"] in reacted}
    want = sorted({a["description"] for a in articles if a["conversation_id"] in alive})
    assert sorted(r[0] for r in E.engaged_descriptions(*frames[:3]).collect()) == want


def test_outer_join_keeps_every_reaction(frames, rows):
    """Reactions without an open comment stay, with nothing else; so the
    measure of missing topics counts them."""
    comments, reactions, articles, topics = rows
    opened = Counter(c["conv_message_id"] for c in comments if c["final_state"] != "blocked")
    joined = E.joined_outer(*frames).collect()
    lone = [r for r in joined if r["conv_message_id"] is None]
    assert len(lone) == sum(r["message_id"] not in opened for r in reactions)
    assert all(r["title"] is None and r["Topic"] is None for r in lone)
    missing = sum(r["Topic"] in (None, -1) for r in joined)
    keys = E.topic_of_reactions(*frames).collect()
    assert len(keys) == len(joined) and sum(r["Topic"] in (None, -1) for r in keys) == missing


def test_report_rows(frames, rows):
    """Ten best rows of each topic decide the conversations; their four best
    comments stay; likes tie by the reaction's number."""
    compiled = expected_compiled(rows)
    best = lambda r: (-r["total_likes"], int(r["message_id"]))
    by_topic, by_conversation = defaultdict(list), defaultdict(list)
    for r in compiled:
        by_topic[r["Topic"]].append(r)
    chosen = {r["conversation_id"] for rs in by_topic.values() for r in sorted(rs, key=best)[:10]}
    for r in compiled:
        if r["conversation_id"] in chosen:
            by_conversation[r["conversation_id"]].append(r)
    want, seen = [], set()
    for rs in by_conversation.values():
        for r in sorted(sorted(rs, key=best)[:4], key=lambda r: (r["Topic"], -r["total_likes"])):
            if (r["conversation_id"], r["conv_message_id"]) not in seen:
                seen.add((r["conversation_id"], r["conv_message_id"]))
                want.append(r)
    keys = R.top_comments(E.compile_keys(*frames), reuse_input=False)
    got = [r.asDict() for r in E.with_articles(keys, frames[2]).collect()]
    assert as_set(got) == as_set(want)


def test_users(spark, frames):
    history = FX.comments_history(spark, SF_SMALL)
    top = R.top_comments(E.compile_keys(*frames), reuse_input=False)
    topic = {}
    for r in top.collect():
        topic[r["conversation_id"]] = max(r["Topic"], topic.get(r["conversation_id"], -1))
    counts = defaultdict(Counter)
    for r in history.collect():
        counts[r["user_id"]][r["conversation_id"]] += 1
    want = {}
    for user, found in counts.items():
        levels = sorted(set(found.values()), reverse=True)
        known = sorted((-n, c) for c, n in found.items() if c in topic)
        want[user] = (None,) * 4 if not known else (
            known[0][1], -known[0][0], levels.index(-known[0][0]) + 1, topic[known[0][1]])
    got = {r["user_id"]: tuple(r)[1:] for r in U.top_topic_per_user(history, top).collect()}
    assert got == want and any(v[0] for v in want.values()) and any(v[0] is None for v in want.values())


def test_all_pairs_sorted(spark):
    history = FX.comments_history(spark, SF_SMALL)
    got = [tuple(r) for r in U.top_conversations(history).collect()]
    want = Counter((r["user_id"], r["conversation_id"]) for r in history.collect())
    assert got == sorted(((u, c, n) for (u, c), n in want.items()), key=lambda x: (-x[2], x[0], x[1]))
