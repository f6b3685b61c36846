"""Detection over streams of texts. It keeps no state; what needs whole documents runs in foreachBatch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.detectors import NAMES
from ..operators.detect import detect
from ..operators.plan import build_plan, rewritten


def detections(containers: DataFrame, names: tuple[str, ...] = NAMES, today: dt.date | None = None) -> DataFrame:
    """The same rows as the batch operator gives, for a streaming DataFrame of containers."""
    if not containers.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return detect(containers, names, today)


def redacted(containers: DataFrame, secret: bytes, sink: Callable[[DataFrame, int], None], checkpoint: str, names: tuple[str, ...] = NAMES) -> StreamingQuery:
    """Each batch must hold whole documents: plans are made within it, and its rewritten containers go to sink(df, batch_id).

    A batch with conflicts fails before the sink sees it.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        made = build_plan(batch, secret, names)
        if not made.conflicts.isEmpty():
            raise ValueError("the batch's plan has conflicts; nothing is written")
        sink(rewritten(batch, made.replacements), batch_id)

    return containers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
