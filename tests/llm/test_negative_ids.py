"""Near copies whose ids are negative."""

from sparkdecide.llm import neardup


def test_op5_near_duplicates_with_negative_ids(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(-9, " ".join(base)), (-5, " ".join([*base[:-1], "x"])), (4, " ".join(["y", *base[1:]])), (-7, "quite another text")]
    got = {x.doc_id: (x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {-9: (-9, True), -5: (-9, False), 4: (-9, False), -7: (-7, True)}
