"""Batch inference with quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.operators.scale import side_by_side

# A response like one of these was blocked, not answered.
QUARANTINE_LIKE = [
    "%blocked%", "%safety%filter%", "%flagged by our safety%", "%could not be processed%", "%personal information%",
]

MODEL_BYTES = 1 << 20  # texts that a model gets at a time, about


def _of_bytes(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def batch_infer(
    df: DataFrame, col: str, load: Callable[[], Callable[[pd.Series], pd.Series]], as_of: Column | None = None
) -> DataFrame:
    """All input columns, ``agent_response``, ``inference_timestamp`` and ``inference_status``.

    ``load`` runs once per task and returns the model: a function from a batch
    of inputs to a batch of responses. Texts reach it about ``MODEL_BYTES`` at a
    time, and each row reaches it once, whatever is done with the response. If the model raises on a batch, its rows
    are tried one by one; a row on which it raises again is kept, with the
    status ``FAILED`` and the error as its response.
    """

    def answers(model: Callable[[pd.Series], pd.Series], batch: pd.Series) -> pd.DataFrame:
        def one(row: pd.Series) -> tuple[str | None, str]:
            try:
                return model(row).iloc[0], "COMPLETED"
            except Exception as e:  # whatever a caller's model raises belongs to its row
                return f"ERROR: {e}", "FAILED"

        try:
            return pd.DataFrame({"response": model(batch).to_numpy(), "status": "COMPLETED"})
        except Exception:
            rows = [one(batch.iloc[i : i + 1]) for i in range(len(batch))]
            return pd.DataFrame(rows, columns=["response", "status"])

    @F.arrow_udf("response string, status string")
    def to_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            for part in _of_bytes(batch, MODEL_BYTES):
                out = answers(model, part.to_pandas())
                columns = [pa.array(out[n], from_pandas=True).cast(pa.string()) for n in out.columns]
                yield pa.StructArray.from_arrays(columns, list(out.columns))

    @F.pandas_udf("response string, status string")
    def to_values(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield answers(model, batch)

    is_text = isinstance(df.select(F.col(col)).schema[0].dataType, T.StringType)
    # A filter on the response must not move below the model and ask it again for every row.
    respond = (to_texts if is_text else to_values).asNondeterministic()
    return df.withColumn("_answer", respond(F.col(col))).select(
        *df.columns, F.col("_answer.response").alias("agent_response"),
        (F.current_timestamp() if as_of is None else as_of).alias("inference_timestamp"),
        F.col("_answer.status").alias("inference_status"),
    )


def is_quarantined(response: Column) -> Column:
    """Never null: a missing response is kept, not quarantined."""
    low = F.lower(response)
    hit = F.lit(False)
    for pattern in QUARANTINE_LIKE:
        hit = hit | low.like(pattern)
    return F.coalesce(hit, F.lit(False))


def quarantine(df: DataFrame, response: str = "agent_response") -> DataFrame:
    return df.where(is_quarantined(F.col(response)))


def clean_output(df: DataFrame, response: str = "agent_response") -> DataFrame:
    """The output without its quarantined rows."""
    return df.where(~is_quarantined(F.col(response)))


def batch_summary(
    source: DataFrame, output: DataFrame, duration_seconds: float = 0.0, response: str = "agent_response"
) -> DataFrame:
    """One row of counts of the input and of the written output, each read once (zeros when empty)."""
    held = F.coalesce(F.sum(F.when(is_quarantined(F.col(response)), 1).otherwise(0)), F.lit(0)).cast("bigint")
    given = source.agg(F.count("*").alias("input_records"))
    written = output.agg(F.count("*").alias("output_records"), held.alias("quarantined_records"))
    return side_by_side([given, written], []).select(
        F.lit("COMPLETED").alias("status"),
        "input_records",
        "output_records",
        "quarantined_records",
        F.when(F.col("input_records") > 0, F.round(F.lit(float(duration_seconds)), 1)).otherwise(0.0).alias("duration_seconds"),
    )
