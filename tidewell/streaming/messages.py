"""Message scans over streams, and the send gate of a conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions.text import bucket, normalize, sigmoid, white_tokens
from tidewell.operators.explain import keyword_margin, occlusion, peak, top_words


def scan(messages: DataFrame, keywords: list[str], entries: dict[str, str], k: int = 3, window: int = 1, text: str = "text") -> DataFrame:
    """Works on streams and tables alike: normalized, words, label, confidence, flagged words, highest bucket."""
    margin = keyword_margin(keywords)
    out = messages.withColumn("normalized", normalize(F.col(text), entries)).withColumn("words", white_tokens("normalized"))
    out = out.withColumn("margin", margin(F.col("words"))).withColumn("label", F.when(F.col("margin") > 0, "HATE").otherwise("CLEAN"))
    p = sigmoid(F.col("margin"))
    out = out.withColumn("confidence", F.when(F.col("margin") > 0, p).otherwise(1 - p)).withColumn("importance", peak(occlusion(F.col("words"), margin, window)))
    flagged: Column = F.transform(top_words(F.col("importance"), k), lambda i: F.get("words", i))
    return out.withColumn("flagged", F.when(F.col("label") == "HATE", flagged).otherwise(F.array().cast("array<string>"))).withColumn("level", bucket(F.coalesce(F.array_max("importance"), F.lit(0.0)), 0.1)).drop("margin")


GATE_OUT = "conv_id long, turn long, status string"


def gate_step(pending: tuple | None, turn: int, flagged: bool, resend: bool) -> tuple[tuple | None, str]:
    """One event: at most one message pends. A flagged one waits as `warning`; sending it again commits it; another replaces it."""
    if pending is not None and resend and pending[0] == turn:
        return None, "sent_anyway"
    if flagged:
        return (turn,), "warning"
    return None, "sent"


def send_gate(scanned: DataFrame) -> DataFrame:
    """A stream or table of (conv_id, turn, flagged boolean, resend boolean) to statuses, with one pending message of state for each conversation."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = tuple(state.get) if state.exists else None
        pending = pending if pending and pending[0] >= 0 else None
        for pdf in parts:
            rows = []
            for r in pdf.sort_values(["turn", "resend"]).itertuples():
                pending, status = gate_step(pending, r.turn, r.flagged, r.resend)
                rows.append((key[0], r.turn, status))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "status"])
        state.update(pending or (-1,))

    return scanned.groupBy("conv_id").applyInPandasWithState(run, GATE_OUT, "turn long", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Tumbling counts of an event stream, late rows within the watermark included."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
