"""Prototypes against plain means and angles."""

import math
import random

from loomspan.operators import prototypes


def test_proposals(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss(k % 3, 1.0) for _ in range(4)], k % 3 if k % 7 else None) for k in range(60)] + [(100, [0.0] * 4, 1), (101, None, 1), (102, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "k int, v array<float>, label int")
    means = {c: [sum(x[1][d] for x in rows if x[2] == c and x[1]) / len([1 for x in rows if x[2] == c and x[1]]) for d in range(4)] for c in range(3)}
    fitted = prototypes.fitted(df, "v", "label")
    assert all(abs(a - b) < 1e-5 for x in fitted.collect() for a, b in zip(x["prototype"], means[x["label"]]))

    def plain(v):
        if v is None or not any(v) or len(v) != 4:
            return None
        s = sorted(((round(sum(a * b for a, b in zip(v, m)) / math.hypot(*v) / math.hypot(*m), 6), -c) for c, m in means.items()), reverse=True)
        return -s[0][1] if s[0][0] >= 0.5 and s[0][0] - s[1][0] >= 0.03 else None

    got = {x["k"]: x["slot"] for x in prototypes.proposed(df, "k", "v", fitted, "label", 0.5, 0.03).collect()}
    assert got == {x[0]: plain(x[1]) for x in rows} and len({v for v in got.values()}) > 2
    assert prototypes.proposed(df, "k", "v", fitted.where("false"), "label", 0.5, 0.03).where("slot IS NOT NULL").count() == 0
