import pytest

from veilgrove.llm import decontaminate as D

TRAIN = "A train leaves Paris at noon and meets the train from Lyon near Dijon, so how far does Anna travel to reach Nice?"
TOM = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"
BOXES = "In the red box there are 5 apples while the small blue box on the big old round wooden table by the open window of the kitchen holds 5 pears and nothing else at all"


@pytest.mark.parametrize(
    ("item", "text", "n"),
    [
        (TRAIN, TRAIN, 16),
        (TRAIN, TRAIN.lower(), 16),
        (TRAIN, TRAIN.upper(), 16),
        (TRAIN, TRAIN.title(), 16),
        (TRAIN, TRAIN.replace("Anna", "Olga"), 16),
        (TOM, TOM.replace("Tom", "Anna").replace("5", "7").replace("3", "9"), 9),
        (TOM, f"Well: {TOM.lower().replace('5', '7')}", 9),
        (BOXES, BOXES.replace("5 apples", "7 apples").replace("5 pears", "9 pears"), 14),
        (TOM, TOM.replace("does Tom", "does Bob").replace("Tom", "Anna"), None),
    ],
)
def test_readings(spark, item, text, n):
    d = spark.createDataFrame([(1, f"Some words before. {text} And some words after.")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = D.contaminated(d, b).collect()
    assert [r.n_matched for r in got] == ([] if n is None else [n])
