"""Aliases by folded slug, and circles of any length among them."""

from loomspan.operators import views


def test_aliases(spark):
    rows = [("Car", "Auto", None), ("auto", "car", "equivalent"), ("Web Map", "map", None), ("bike", "cycle", "equivalent"), ("bike", "motor", None), ("Rivers", "water", "broader"), ("tree", "plant", "kind-of"), ("same", "Same", None)]
    rows += [("p", "q", None), ("q", "r", None), ("r", "s", None), ("s", "q", None), ("", "x", None), ("y", None, None)]
    good, relations, errors = views.alias_rows(spark.createDataFrame(rows, "from string, to string, kind string"))
    at = lambda df: sorted(map(tuple, df.collect()))
    assert ("bike", "cycle") in at(good) and ("web-map", "map") in at(good) and not any(a == b for a, b in at(good))
    assert at(relations) == [("river", "water", "broader")]
    assert at(errors) == [("alias-conflict", "bike", "cycle"), ("alias-cycle", "auto", "car"), ("alias-cycle", "q", "r"), ("alias-not-equivalent", "tree", "plant")]
