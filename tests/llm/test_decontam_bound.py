"""The length from which a copied stretch of a long item is sure to be found."""

from __future__ import annotations

from shelfmark.llm.decontam import PASSAGE, STRIDE, contaminated


def test_a_stretch_of_the_stated_length_is_found_wherever_it_starts(spark, frame, prose):
    item, sure = prose(80, 7)[:400], PASSAGE + STRIDE - 1
    assert sure == 103
    starts = range(len(item) - sure + 1)
    docs = frame([(k, f"{prose(30, 100 + k)}zq{item[k : k + sure]}zq{prose(30, 900 + k)}") for k in starts])
    got = {r.doc_id for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == set(starts)
