"""What the executed plans must look like: filters in the scan, no article
text in the big joins, tables read once."""

import re

import pytest

from conftest import SF_SMALL
from threadlens.catalog import QUERIES
from threadlens.plans import engagement as E, report as R
from threadlens.sources import fixtures as FX


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scans(plan, table):
    return [line for line in plan.split("\n") if "FileScan" in line and f"/{table}.parquet" in line]


def test_blocked_filter_reaches_the_scan(spark):
    for df in (FX.open_comments(spark, SF_SMALL), E.compile_keys(
            FX.open_comments(spark, SF_SMALL), FX.reactions(spark, SF_SMALL), FX.articles(spark, SF_SMALL),
            FX.doc_topic(spark, SF_SMALL))):
        lines = scans(executed(df), "events")
        assert lines and all(re.search(r"PushedFilters: \[.*event_type", line) for line in lines)
    assert re.search(r"PushedFilters: \[.*final_state", executed(QUERIES["filter_blocked"](spark, SF_SMALL)))


def test_no_article_text_in_the_ranking_input(spark):
    rows = E.compile_keys(FX.open_comments(spark, SF_SMALL), FX.reactions(spark, SF_SMALL),
                          FX.articles(spark, SF_SMALL), FX.doc_topic(spark, SF_SMALL))
    assert "description" not in rows.columns and "description" not in R.top_comments(rows, reuse_input=False).columns
    joins = [x for x in executed(rows).split("\n") if "Exchange hashpartitioning(conv_message_id" in x]
    assert not any("description" in x for x in joins)


def test_pages_are_read_only_for_urls(spark):
    plan = executed(QUERIES["engaged_descriptions"](spark, SF_SMALL))
    assert not scans(plan, "pages") and len(scans(plan, "events")) == 1


@pytest.mark.parametrize("name", ["dedupe_keep_first", "top_topic_per_user"])
def test_events_are_read_once(spark, name, monkeypatch):
    """Compiled keys and history counts are each written once; the result's
    own plan reads those."""
    writes = []
    real = FX.table
    monkeypatch.setattr(FX, "table", lambda s, d, t: (writes.append(t), real(s, d, t))[1])
    plan = executed(QUERIES[name](spark, SF_SMALL))
    assert not scans(plan, "events")
    assert writes.count("events") == (1 if name == "dedupe_keep_first" else 2)  # comments, and history


def _texts_shuffled_unfiltered(plan):
    """Exchanges above a scan of article texts that no semi join has filtered."""
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    bad = []
    for n, line in enumerate(lines):
        if "FileScan" not in line or "/documents.parquet" not in line or "text" not in line:
            continue
        at = depth(line)
        for above in reversed(lines[:n]):
            if depth(above) >= at:
                continue
            at = depth(above)
            if "LeftSemi" in above:
                break
            if "Exchange" in above:
                bad.append(above.strip())
    return bad


@pytest.mark.parametrize("name", ["top_comments", "hec_wide", "topic_report"])
def test_only_texts_of_kept_articles_are_shuffled(spark, name):
    plan = executed(QUERIES[name](spark, SF_SMALL))
    assert scans(plan, "documents")
    assert not _texts_shuffled_unfiltered(plan)


def test_the_whole_compiled_table_shuffles_all_texts(spark):
    """What the test above looks for is found where every article is wanted."""
    assert _texts_shuffled_unfiltered(executed(QUERIES["compile_engagement"](spark, SF_SMALL)))


def test_coverage_joins_digests(spark):
    plan = executed(QUERIES["topic_coverage"](spark, SF_SMALL))
    joins = [x for x in plan.split("\n") if "Join" in x]
    # the fixture joins its labels by id; the operator joins digests, once
    assert sum("__key" in x for x in joins) == 1 and not any("escription" in x or "text" in x for x in joins)
