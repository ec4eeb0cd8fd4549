"""New records against a static master, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkweave.operators.blocking import Blocking, candidates
from linkweave.operators.compare import Record


def link_stream(stream: DataFrame, master: DataFrame, blockings: list[Blocking], comparator: Record, classifier: Callable[[DataFrame], DataFrame], id_col: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch is blocked, compared and classified against master; scored
    pairs go to out/batch=N, so that a batch run again replaces its own output."""

    def link(batch: DataFrame, n: int) -> None:
        pairs = candidates(batch, blockings, id_col, master)
        classifier(comparator.compare(pairs, batch, master, id_col)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
