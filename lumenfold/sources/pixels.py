"""Encoders and heads as pluggable batch functions: any object with embed_texts / score works in a plan.

Real towers and detectors need model files, which are not part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Turns texts (or decoded pictures) into unit vectors."""

    dim: int
    model_id: str

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...


def embed(df: DataFrame, text: str, make: Callable[[], Encoder], out: str = "e") -> DataFrame:
    """Adds a vector per text; the encoder is made once a task and sees whole Arrow batches. Null texts give null."""

    @F.pandas_udf("array<double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in batches:
            known = s.notna().to_numpy()
            vec = [None] * len(s)
            for i, v in zip(np.flatnonzero(known), encoder.embed_texts(s[known].tolist()) if known.any() else ()):
                vec[i] = v.tolist()
            yield pd.Series(vec, dtype=object)

    return df.withColumn(out, f(F.col(text)))


def apply_heads(df: DataFrame, ident: str, vec: str, heads: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(ident, head, p, error): every head over every batch. A head that fails gives null scores and the error's text for that
    batch and does not disturb the others; NaN means not scored."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf[vec].to_numpy())
            for name, head in heads.items():
                try:
                    p, error = pd.Series(np.asarray(head(x), float)), None
                except Exception as e:  # noqa: BLE001 - isolated by design
                    p, error = pd.Series(np.full(len(pdf), np.nan)), f"{type(e).__name__}: {e}"[:200]
                yield pd.DataFrame({ident: pdf[ident].to_numpy(), "head": name, "p": p.astype("Float64").where(p.notna(), None), "error": error})

    kind = df.schema[ident].dataType.simpleString()
    return df.where(F.col(vec).isNotNull()).select(ident, vec).mapInPandas(f, f"{ident} {kind}, head string, p double, error string")


def flat(pixels: np.ndarray, least: float = 1.0) -> bool:
    """Whether a picture has no content: its mean absolute Laplacian stays under `least`."""
    x = pixels.astype(float)
    if x.shape[0] < 3 or x.shape[1] < 3:
        return True
    lap = 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    return float(np.abs(lap).mean()) < least
