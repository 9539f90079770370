"""Matching a stream of probes with a built index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.index import RuleIndex


def match_stream(index: RuleIndex, probes: DataFrame, **names: str) -> DataFrame:
    """Probes as they arrive with the IDs that match them: a stateless stream-static join, without watermark or state.

    An index with sets kept apart (IDs of very many values) needs joins that streams lack; match_batches does for any index.
    """
    if index.wide:
        raise ValueError("this index keeps large value sets apart; use match_batches")
    return index.match(probes, **names)


def match_batches(index: RuleIndex, probes: DataFrame, sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer (to be started) that hands each micro-batch's matches to sink(matches, batch id); a sink keyed by the id is exactly-once."""
    return probes.writeStream.foreachBatch(lambda batch, number: sink(index.match(batch, **options), number))
