"""Isotonic calibration of confidences from review labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MIN_SAMPLES, MIN_POSITIVES, MIN_NEGATIVES = 20, 3, 3


def pool(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (middle of each block's range, its mean within 0 and 1); x ascending."""
    blocks: list[list[float]] = []  # sum, count, least x, greatest x
    for a, b in zip(x, y):
        blocks.append([float(b), 1, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    return np.array([(b[2] + b[3]) / 2 for b in blocks]), np.clip([b[0] / b[1] for b in blocks], 0, 1)


def predict(anchors: np.ndarray, values: np.ndarray, x) -> np.ndarray:
    """Linear between anchors, flat beyond them."""
    return np.interp(x, anchors, values)


def fit(examples: DataFrame) -> DataFrame:
    """(field, block, anchor, value) of every field with labels enough; ``examples`` (field, doc_id, confidence, label). A field's labels are reviews by people: they fit one task."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=["confidence", "label"]).sort_values(["confidence", "doc_id"], kind="stable")
        if len(p) < MIN_SAMPLES or p.label.sum() < MIN_POSITIVES or (1 - p.label).sum() < MIN_NEGATIVES:
            return pd.DataFrame({"field": pd.Series(dtype=str), "block": pd.Series(dtype="int32"), "anchor": pd.Series(dtype=float), "value": pd.Series(dtype=float)})
        a, v = pool(p.confidence.to_numpy(), p.label.to_numpy())
        return pd.DataFrame({"field": p.field.iloc[0], "block": range(len(a)), "anchor": a, "value": v})

    return examples.groupBy("field").applyInPandas(one, "field string, block int, anchor double, value double")
