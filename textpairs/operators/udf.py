"""User hooks (M01, M02): the only Python in the data path, Arrow-batched.

M01 runs a user-supplied corrector over batches of sentences with ``mapInPandas`` (the
reference calls its models batch by batch); M02 plugs a user tokenizer in as a pandas UDF.
The user brings the model; tests use pure-Python stubs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def correct_batches(df: DataFrame, corrector: Callable[[list[str]], list[str]], text_col: str = "src",
                    out_col: str = "pred", batch_size: int = 256) -> DataFrame:
    """``corrector(list[str]) -> list[str]`` applied in batches of ``batch_size``.

    Runs per partition (no shuffle); a batch whose output length differs fails the task
    (the reference would silently misalign).
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text_col].tolist()
            outs: list[str] = []
            for start in range(0, len(texts), batch_size):
                chunk = texts[start:start + batch_size]
                res = list(corrector(chunk))
                if len(res) != len(chunk):
                    raise ValueError(f"corrector returned {len(res)} outputs for {len(chunk)} inputs")
                outs.extend(res)
            yield pdf.assign(**{out_col: outs})

    return df.mapInPandas(run, schema)


def tokenizer_udf(tokenize: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A user tokenizer (``str -> list[str]``) as an Arrow-batched pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tok(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else list(tokenize(x)))

    return tok
