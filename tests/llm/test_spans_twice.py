import random

import pytest

from corvex.llm import spans
from tests.llm.test_found import brute


@pytest.mark.parametrize("ids", [(1, 2), (2, 1)])
def test_a_document_that_holds_a_passage_again_in_part(spark, ids):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    docs = {}
    for i in range(10):
        passage = text(600)
        docs[10 * i + ids[0]] = text(300) + passage + text(300) + passage[120:400] + text(300)
        docs[10 * i + ids[1]] = text(200) + passage + text(200)
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    assert {tuple(r) for r in spans.shared_spans(df, length=200).collect()} == brute(docs, 200)
