"""Matches of an item that many documents hold: their file is small, their rows are not, and none are gathered on the driver."""

from sparkdecide.llm import decontaminate

from .test_leaks import LONG, NAMED
from .test_operators import DOCS, leak_rows

TEXTS = [LONG, LONG.replace("sold", "gladly sold"), LONG.replace("500", "1,500"), "nothing of this is asked anywhere", NAMED.replace("Tom", "Mary Ann")]


def test_op7_decontaminate_joins_matches_by_sorting(spark):
    n = 1000
    items = spark.createDataFrame([(0, LONG), (1, NAMED)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame([(k, TEXTS[k % len(TEXTS)]) for k in range(n)], DOCS), items)
    got = {x.doc_id: (x.item_id, x.kind) for x in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()  # the final one and the initial one
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    few = {k: (v.item_id, v.kind) for k, v in leak_rows(spark, TEXTS, (LONG, NAMED)).items()}
    assert set(few) == {0, 1, 2, 4} and got == {k: few[k % len(TEXTS)] for k in range(n) if k % len(TEXTS) != 3}


def test_op7_decontaminate_broadcasts_items_up_to_a_bound_only(spark, monkeypatch):
    plans = []

    def planned(df, name, write=decontaminate.materialize):
        if name == "matches":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(decontaminate, "materialize", planned)
    got = []
    for most in (16 << 20, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST", most, raising=False)
        got.append(leak_rows(spark, TEXTS, (LONG, NAMED)))
    assert got[0] == got[1] and set(got[0]) == {0, 1, 2, 4}
    assert ["Broadcast" in p for p in plans] == [True, False]
