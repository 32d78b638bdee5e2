"""What the divergence of histograms says about repetition: run as a script with a folder of tables."""

from __future__ import annotations

import sys

import numpy as np


def figures(spark, folder: str) -> list[tuple]:
    """Shortest text judged, segments, area under the curve, and recall at as many hits as segments repeat, against the repeated share."""
    from cuewright.llm.divergence import divergence
    from cuewright.llm.repetition import repetition
    from cuewright.operators.keys import once
    from cuewright.plans.tables import table

    keys = ["media_id", "take_no", "seg_no"]
    s = once(table(spark, folder, "segments"), keys, ["text"])
    out = []
    for shortest in (0, 60, 120):
        rows = repetition(divergence(s, shortest=shortest).withColumnRenamed("divergence", "d")).where("d is not null").select("d", "repeated_share").toPandas()
        score, truth = rows.d.to_numpy(), rows.repeated_share.to_numpy() > 0.5
        order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
        pos, neg = truth.sum(), (~truth).sum()
        area = (order[truth].sum() - pos * (pos + 1) / 2) / max(pos * neg, 1)
        top = np.argsort(-score, kind="stable")[:pos]
        out.append((shortest, len(rows), round(float(area), 2), round(float(truth[top].mean()), 2) if pos else 0.0))
    return out


if __name__ == "__main__":
    from cuewright.session import local_session

    print(*figures(local_session(8, 8), sys.argv[1]), sep="\n")
