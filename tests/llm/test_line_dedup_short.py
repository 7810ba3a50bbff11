import pytest

from veilgrove.llm import line_dedup as L

ROWS = [(1, "All rights reserved.\na b c d e\nx y"), (2, "reserved. All rights\na b c d\nx z"), (3, "All rights reserved.\nx y\nx y w")]


@pytest.mark.parametrize(
    ("kw", "want"),
    [
        ({"cold": 1}, {1: ROWS[0][1], 2: "x z", 3: "x y w"}),
        ({"min_words": 5}, dict(ROWS)),
    ],
)
def test_short_lines_match_across_documents(spark, kw, want):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup(df, **kw).collect()} == want
