"""The governor over Structured Streaming: keyed state holds the last observation and the running latency.

Rows of a run must arrive in the order of their hop; a row at or before the last hop seen is late and is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.governor import MARGINS, PROFILES, decide

_OUT = "run string, hop bigint, vram_mb double, temp_c double, hop_ms double, d_temp double, d_vram double, d_ms double, elapsed_ms double"
_STATE = "hop bigint, vram_mb double, temp_c double, hop_ms double, elapsed_ms double"


def _slopes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    for pdf in batches:
        rows = []
        for hop, vram, temp, ms in pdf.sort_values("hop")[["hop", "vram_mb", "temp_c", "hop_ms"]].itertuples(index=False):
            if last is not None and hop <= last[0]:
                continue
            d = (temp - last[2], vram - last[1], ms - last[3]) if last is not None else (0.0, 0.0, 0.0)
            elapsed = ms + (last[4] if last is not None else 0.0)
            last = (int(hop), float(vram), float(temp), float(ms), float(elapsed))
            rows.append((key[0], int(hop), vram, temp, ms, *d, elapsed))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
    if last is not None:
        state.update(last)


def stream_gates(telemetry: DataFrame, profile: str = "card-a") -> DataFrame:
    """Decisions for a stream (or a table) of (run, hop, vram_mb, temp_c, hop_ms), equal to the batch gates."""
    typed = telemetry.select(F.col("run").cast("string").alias("run"), F.col("hop").cast("bigint").alias("hop"), *[F.col(c).cast("double").alias(c) for c in ("vram_mb", "temp_c", "hop_ms")])
    with_slopes = typed.groupBy("run").applyInPandasWithState(_slopes, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    limits = {**PROFILES[profile], **MARGINS}
    decision, reason = decide()
    return with_slopes.withColumns({k: F.lit(v) for k, v in limits.items()}).select("run", "hop", decision.alias("decision"), reason.alias("reason"), "elapsed_ms")
