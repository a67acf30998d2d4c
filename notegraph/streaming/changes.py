"""Incremental notes: what changes in a stream of note texts.

The parser is a projection and takes streams as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _told(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one path whose hash is not that of the row before."""
    rows = pd.concat(list(chunks)).sort_values(["at", "sha256"])
    last, at = state.get if state.exists else (None, None)
    if at is not None:
        rows = rows[rows["at"] >= at]
    if len(rows):
        before = rows["sha256"].shift(fill_value=last or "")
        state.update((rows["sha256"].iloc[-1], int(rows["at"].iloc[-1])))
        rows = rows[rows["sha256"] != before]
        yield pd.DataFrame({"rel_path": key[0], "sha256": rows["sha256"], "at": rows["at"]})


def content_changes(texts: DataFrame) -> DataFrame:
    """``(rel_path, sha256, seen)`` of texts ``(rel_path, text, seen)`` that differ from their path's last one.

    The state is one hash and one time for each path, for as long as the
    stream runs, so a text that comes back after another counts again.  Rows
    of one micro-batch are taken in order of ``seen``; what comes after a
    later state of its path was told is left out, as are rows without a time.
    Only hashes are grouped, not texts.
    """
    hashed = texts.where("seen is not null").select("rel_path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.unix_micros("seen").alias("at"))
    told = hashed.groupBy("rel_path").applyInPandasWithState(_told, "rel_path string, sha256 string, at bigint", "sha256 string, at bigint", "append", GroupStateTimeout.NoTimeout)
    return told.select("rel_path", "sha256", F.timestamp_micros("at").alias("seen"))
