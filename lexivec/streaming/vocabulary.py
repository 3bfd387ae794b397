"""Word frequencies of a corpus that keeps arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexivec.operators.vocab import word_freq
from lexivec.scratch import scratch_root


def running_vocabulary(
    arriving: DataFrame, name: str, sink: Callable[[DataFrame, int], None], text: str = "text"
) -> StreamingQuery:
    """Count the words of a stream of documents and hand the changed counts of each batch to ``sink``.

    It is the aggregation of a stored corpus; Spark keeps the counts as state below the shared
    checkpoint folder, so a restarted query goes on where it stopped.
    """
    folder = f"{scratch_root(arriving.sparkSession)}/lexivec/stream-{name}"
    counts = word_freq(arriving, text).writeStream.outputMode("update").queryName(name)
    return counts.option("checkpointLocation", folder).foreachBatch(sink).trigger(availableNow=True).start()
