"""Raw answers are gathered where they lie; only whole assessments are shuffled."""

import random

import pytest

from panelstats.operators import panel


def _answers(spark, partitions=3):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([1, 2, 3, None]), rnd.choice(["q1", "q2", "q3", "rare", None]),
             rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y", None]), i) for i in range(300)]
    rows += [("few", 1, "only few", 1, "z", 300)]
    return spark.createDataFrame(rows, "p string, n int, q string, t int, v string, i int").repartition(partitions, "i")


def _plain(df, min_exclusive, labels_of_kept):
    kept = panel.keep_participants(df, "p", "n", min_exclusive)
    labels = sorted(r[0] for r in (kept if labels_of_kept else df).select("q").dropna().distinct().collect())
    return panel.pivot_first(kept, ["p", "n"], "q", "v", ["t", "i"], labels)


def _rows(df):
    return df.columns, sorted(map(str, df.collect()))


@pytest.mark.parametrize("labels_of_kept", [True, False])
@pytest.mark.parametrize("gather, scan, broadcast", [(7, 256, 100), (100_000, 1, 100), (7, 1, 0), (50, 256, 0)])
def test_pivot_kept_whatever_the_stretches_labels_and_join(spark, monkeypatch, gather, scan, broadcast, labels_of_kept):
    monkeypatch.setattr(panel, "LABEL_SCAN", scan)
    real = panel.gathered
    monkeypatch.setattr(panel, "gathered", lambda df, n: real(df, n, gather))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = _answers(spark)
        got = panel.pivot_kept(df, ["p", "n"], "q", "v", ["t", "i"], "p", "n", 2, labels_of_kept, broadcast)
        assert _rows(got) == _rows(_plain(df, 2, labels_of_kept))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_single_answer_is_shuffled(spark, monkeypatch):
    stored = []
    real = panel.handover
    monkeypatch.setattr(panel, "handover", lambda df, name: stored.append((name, df)) or real(df, name))
    df = _answers(spark, 1).sortWithinPartitions("p", "n")
    panel.pivot_kept(df, ["p", "n"], "q", "v", ["t", "i"], "p", "n", 2).collect()
    name, cells = stored[0]
    assert name == "answer_cells"
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.replace("hashpartitioning(i#", "")
    assert cells.count() == df.select("p", "n").distinct().count() < df.count()


def test_keys_of_any_kind_are_gathered(spark):
    df = spark.createDataFrame([((1, "a"), 0.0, "x"), ((1, "a"), 0.0, "y"), ((2, None), float("nan"), "z"), (None, None, None)],
                               "k struct<i: int, s: string>, d double, v string").coalesce(1)
    got = {(str(r["k"]), str(r["d"])): r["v"] for r in panel.gathered(df, 2).collect()}
    assert got == {("Row(i=1, s='a')", "0.0"): ["x", "y"], ("Row(i=2, s=None)", "nan"): ["z"], ("None", "None"): [None]}


def test_merging_tasks_grow_with_the_answers(spark, monkeypatch):
    monkeypatch.setattr(panel, "MERGE_ANSWERS", 5)
    df = _answers(spark)
    got = panel.pivot_kept(df, ["p", "n"], "q", "v", ["t", "i"], "p", "n", 2)
    assert got.rdd.getNumPartitions() >= 16  # at least the 80 answers that all stretches together hold
    assert _rows(got) == _rows(_plain(df, 2, True))


@pytest.mark.parametrize("broadcast", [100, 0])
def test_only_assessments_in_several_stretches_are_moved(spark, monkeypatch, broadcast):
    monkeypatch.setattr(panel, "MOVED_ANSWERS", 0)
    df = _answers(spark, 1).sortWithinPartitions("p", "n")
    real = panel.gathered
    monkeypatch.setattr(panel, "gathered", lambda df, n: real(df, n, 50))  # cuts a few assessments in two
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        stored = []
        write = panel.handover
        monkeypatch.setattr(panel, "handover", lambda df, name: stored.append((name, write(df, name))) or stored[-1][1])
        got = panel.pivot_kept(df, ["p", "n"], "q", "v", ["t", "i"], "p", "n", 2, True, broadcast)
        assert _rows(got) == _rows(_plain(df, 2, True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    several = {r[0] for r in dict(stored)["several_stretches"].collect()}
    keys = df.select("p", "n").distinct()
    assert 0 < len(several) < keys.count()
    assert ("Union" in got._jdf.queryExecution().analyzed().toString()) == (broadcast > 0)


@pytest.mark.parametrize("parts", [1, 3])
def test_answers_of_which_all_or_no_assessments_are_in_several_stretches(spark, monkeypatch, parts):
    monkeypatch.setattr(panel, "MOVED_ANSWERS", 0)
    df = _answers(spark, parts) if parts > 1 else _answers(spark, 1).sortWithinPartitions("p", "n")
    assert _rows(panel.pivot_kept(df, ["p", "n"], "q", "v", ["t", "i"], "p", "n", 2)) == _rows(_plain(df, 2, True))


def test_labels_are_cleaned_before_answers_count_as_of_one_label(spark, monkeypatch):
    rows = [("a", 1, "1_What's it?", 2, "late"), ("a", 1, "1_Whats it", 1, "early"), ("a", 1, "2_x", None, "none"), ("a", 2, None, 1, "n")]
    df = spark.createDataFrame(rows, "p string, n int, q string, t int, v string").coalesce(1)
    found = []
    for reduces in (panel.reduces, lambda schema: False):
        monkeypatch.setattr(panel, "reduces", reduces)
        found.append(_rows(panel.pivot_kept(df, ["p", "n"], "q", "v", ["t"], "p", "n", 1, clean=True)))
    assert found[0] == found[1]
    assert found[0][0] == ["p", "n", "1_Whats it", "2_x"] and "Row(p='a', n=1, 1_Whats it='early', 2_x='none')" in found[0][1]


def test_ties_take_the_least_value_and_null_first_whatever_the_way(spark, monkeypatch):
    rows = [("a", i, f"q{j % 3}", [1, None, 1, 1][j % 4], [None, "x", "y", "x", None][j % 5]) for i in range(3) for j in range(20)]
    df = spark.createDataFrame(rows, "p string, n int, q string, t int, v string").coalesce(1)
    for order in (["t"], ["t", "v"], ["v", "t"]):
        found = []
        for reduces in (panel.reduces, lambda schema: False):
            monkeypatch.setattr(panel, "reduces", reduces)
            found.append(_rows(panel.pivot_kept(df, ["p", "n"], "q", "v", order, "p", "n", 1)))
        monkeypatch.undo()
        assert found[0] == found[1]


@pytest.mark.parametrize("hashed", [8_000_000, 0])
@pytest.mark.parametrize("moved", [0, 1_000_000])
def test_kept_participants_too_many_to_broadcast_are_told_by_hashes(spark, monkeypatch, hashed, moved):
    monkeypatch.setattr(panel, "HASHED_IDS", hashed)
    monkeypatch.setattr(panel, "MOVED_ANSWERS", moved)
    stored = []
    write = panel.handover
    monkeypatch.setattr(panel, "handover", lambda df, name: stored.append(name) or write(df, name))
    df = _answers(spark)
    got = panel.pivot_kept(df, ["p", "n"], "q", "v", ["t", "i"], "p", "n", 2, True, 0)
    assert _rows(got) == _rows(_plain(df, 2, True))
    assert ("kept_cells" in stored) == (hashed == 0)  # the cells are joined by participant only beyond the bound
