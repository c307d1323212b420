"""Text embedding (I1): a built-in hashing embedder and a seam for real models.

``hashing_embed`` is the default model: signed feature hashing (Weinberger et al., 2009)
of whitespace tokens, averaged over the text's tokens. A row is embedded where it is, without
a shuffle, by numpy on Arrow batches, and the result can be reproduced in SQL. The whole text
is used; a missing text embeds as zeros.

``model_embed`` plugs any batch model ``fn(list[str]) -> np.ndarray (n, dim)`` in through an
iterator pandas UDF: the model is built once per Python worker and fed Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TOKEN_SPLIT = r"[ \t\n\r]+"


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens; null/non-string text gives no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), TOKEN_SPLIT), lambda x: x != "")


def hashing_vector(text: Column, dim: int = 64, seed: int = 0) -> Column:
    """Mean over the tokens of a text of signed one-hot vectors at md5-chosen positions.

    Texts are split by Spark; a batch's distinct tokens are hashed once each and its
    vectors counted in one pass over the batch's tokens, whatever the dimension.
    """
    @F.arrow_udf("array<double>")
    def _vectors(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        salt = f":{seed}".encode()
        for lists in it:
            words = lists.flatten().cast(pa.binary()).dictionary_encode()
            digests = [hashlib.md5(w + salt).hexdigest() for w in words.dictionary.to_pylist()]
            pos = np.array([int(h[:8], 16) % dim for h in digests], dtype="int64")
            sign = np.array([1.0 - 2.0 * (int(h[8], 16) % 2) for h in digests])
            which = words.indices.to_numpy()
            n = np.diff(lists.offsets.to_numpy())
            cell = np.repeat(np.arange(len(n)) * dim, n) + pos[which]
            total = np.bincount(cell, weights=sign[which], minlength=len(n) * dim)
            mean = (total.reshape(len(n), dim) / np.maximum(n, 1)[:, None]).ravel()
            yield pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype="int32") * dim, pa.array(mean))
    return _vectors(tokens(text))


def hashing_embed(df: DataFrame, key: str, text_col: str, dim: int = 64, seed: int = 0, out: str = "vec") -> DataFrame:
    """key, vec: ``hashing_vector`` of each row's whole text."""
    return df.select(key, hashing_vector(F.col(text_col), dim, seed).alias(out))


def model_embed(df: DataFrame, text_col: str, model_factory: Callable[[], Callable], dim: int,
                out: str = "vec") -> DataFrame:
    """Embed with a pluggable batch model (``model_factory()`` -> fn(list[str]) -> (n, dim)).

    Non-string or missing text becomes ''. Batches follow
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    @F.pandas_udf("array<double>")
    def _embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = model_factory()
        for s in it:
            texts = [t if isinstance(t, str) else "" for t in s.tolist()]
            m = np.asarray(fn(texts), dtype="float64").reshape(len(texts), dim)
            yield pd.Series(list(m))
    return df.withColumn(out, _embed(F.col(text_col)))
