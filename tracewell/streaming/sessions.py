"""Jump counts per session of a stream.

The batch operators order a whole trace; a stream has it only piece by piece, so the
session is the trace: events of a key without a gap longer than ``gap``.  Late events
within the watermark still join their session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_jumps(events: DataFrame, key: str, time: str, level: str, tie: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per session: start, end, steps, jumps and jump rate.  Works on batch and streaming frames (append mode)."""
    watermarked = events.withWatermark(time, late) if events.isStreaming else events
    sessions = watermarked.groupBy(key, F.session_window(time, gap).alias("session")).agg(F.array_sort(F.collect_list(F.struct(time, tie, level))).alias("steps"))
    levels = sessions.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), F.transform("steps", lambda s: s[level]).alias("xs"))
    n = F.size("xs")
    changes = F.zip_with(F.slice("xs", 2, F.greatest(n - 1, F.lit(0))), F.slice("xs", 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.when(a != b, 1).otherwise(0))
    jumps = F.aggregate(changes, F.lit(0), lambda x, y: x + y)
    return levels.select(key, "start", "end", n.alias("n_steps"), jumps.alias("jump_count"), F.when(n > 1, jumps / (n - 1)).otherwise(0.0).alias("jump_rate"))
