"""An extension, not a parity item: profile arriving batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.profile import profile


def profile_stream(stream: DataFrame, columns: Sequence[str], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Profile every micro-batch and hand (profile, batch id) to sink; the same batch profile as for a table."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(profile(batch, columns), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
