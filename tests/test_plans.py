"""Physical-plan shape of the headline queries: the scale design, locked in."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def reads(df, name: str) -> bool:
    return any(name in f for f in df.inputFiles())


@pytest.fixture(scope="module")
def q(spark):
    return lambda name: entry.queries()[name](spark, SF)


def test_flagship_reads_stored_cells_once_and_no_window_holds_a_participant(q):
    w = q("wide_scores")
    p = plan(w)
    assert not reads(w, "events.parquet") and p.count("FileScan parquet") == 2  # the cells and the kept ids
    assert "Window" not in p and "SortMergeJoin" not in p
    # cells are shuffled once, on (user, day)
    assert [len(re.findall(r"#", h)) for h in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)] == [2]


def test_wrangle_reads_the_answers_once(spark, monkeypatch, tmp_path):
    """Of E1's jobs only the one that stores the cells scans the raw answers, also with a participant
    that holds a third of all rows."""
    from panelstats.operators import panel
    from panelstats.plans import questionnaire
    from tests.fixtures import answers_frame

    path = str(tmp_path / "raw_answers")
    raw = answers_frame(spark)
    hot = raw.where("participantUUID = 'P1_1'")
    for _ in range(3):
        hot = hot.unionByName(hot)
    raw.unionByName(hot).write.parquet(path)
    stored = []
    real = panel.handover
    monkeypatch.setattr(panel, "handover", lambda df, name: stored.append((name, df)) or real(df, name))
    wide = questionnaire.wrangle(spark.read.parquet(path), sort=False)
    assert [n for n, df in stored if reads(df, "raw_answers")] == ["answer_cells"]
    assert plan(stored[0][1]).count("FileScan parquet") == 1
    assert not reads(wide, "raw_answers") and "Window" not in plan(wide)
    assert sorted(map(str, wide.collect())) == sorted(map(str, questionnaire.wrangle(raw, sort=False).collect()))


def test_codebook_is_broadcast_answers_not_shuffled(q):
    p = plan(q("ordinal_scores"))
    assert "BroadcastHashJoin" in p and "BroadcastExchange" in p
    assert "Exchange hashpartitioning" not in p


def test_gamma_counts_cells_in_one_scan(spark):
    """One scan of the table gives the cells; what follows reads only the stored cells."""
    from panelstats.operators import association

    df = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(association.contingency(df, [("o_orderstatus", "o_orderpriority"), ("o_orderpriority", "o_orderstatus")]))
    assert p.count("FileScan parquet") == 1 and len(re.findall(r"Exchange hashpartitioning", p)) == 1
    g = association.gamma(df, [("o_orderstatus", "o_orderpriority")], level=None)
    p = plan(g)
    assert not reads(g, "orders.parquet") and "Join" not in p and len(re.findall(r"Exchange", p)) <= 2


def test_no_window_of_strips_holds_a_whole_pair(spark, monkeypatch):
    from panelstats.operators import association, dominance

    monkeypatch.setattr(dominance, "MOST_DIGITS", 3)
    p = plan(association.gamma(spark.read.parquet(f"{SF}/lineitem.parquet"), [("l_extendedprice", "l_quantity")], level=None))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", p)
    assert windows
    # every window is cut by a strip, or ranges over the table of strip pairs alone
    assert all("__s" in w or "__node" in w for w in windows)


def test_answer_tally_one_pass(q):
    p = plan(q("answer_tally"))
    assert p.count("FileScan parquet") == 1 and "Join" not in p


def test_pushdown_and_pruning(q):
    p = plan(q("drop_out_of_scope"))
    assert "PushedFilters: [IsNotNull(l_linenumber), LessThan(l_linenumber,6)]" in p
    p = plan(q("participants"))
    assert "ReadSchema: struct<user_id:bigint>" in p


def test_distinct_counts_are_two_level(q):
    p = plan(q("mean_assessments"))
    # distinct (user, day) is shuffled on both keys before counting per user
    assert re.search(r"Exchange hashpartitioning\(user_id#\d+L, day#\d+", p)


def test_pivot_reduces_before_spreading(q):
    p = plan(q("pivot_wide"))
    # one min_by per raw row whatever the number of labels, then cells only; the labels' positions come
    # from a broadcast dictionary
    assert p.count("partial_min_by") == 1
    assert p.count("FileScan parquet") == 1 and "SortMergeJoin" not in p


def test_no_row_carrying_single_partition(q):
    for name in ("kept_answers", "baseline_join"):
        assert "SinglePartition" not in plan(q(name))
