"""Source slots of a session: ids, the limit, and replies to opens and closes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import scan
from wavemill.operators.blocks import running_sum


def _clamped(max_sources: int):
    def run(batch: pa.RecordBatch, base: int) -> Iterator[pa.RecordBatch]:
        begin, n = scan.starts(batch.column(0)), batch.num_rows
        shift, lo, hi = scan.clamp_prefixes(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), begin, 1, max_sources)
        first = np.zeros(n, bool)
        first[begin] = True
        before = [np.where(first, none, np.roll(x, 1)) for x, none in ((shift, 0), (lo, 1), (hi, max_sources))]
        last = np.append(first[1:], True)
        added = [pa.array(np.full(n, base)), pa.array(last), *map(pa.array, (shift, lo, hi, *before))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "piece", "last", "shift", "lo", "hi", "shift0", "lo0", "hi0"])

    return run


def slots(commands: DataFrame, by: str, order: list[str], max_sources: int = 2) -> DataFrame:
    """``commands(by, order..., k)`` with k 1 (open), -1 (close the last opened) or 0.

    Source 0 is open from the start; an open takes the next id unless the limit
    is reached; ids are never used twice, and a refused open takes none. Replies:
    opened, source_limit, closed, source_not_found, none. Rows of equal ``order``
    go by k.

    The number of live sources is a walk held between 1 and the limit. Its steps
    compose to clamps, so a session of any length spreads over tasks.
    """
    rows = commands.select(by, *order, F.col("k").cast("long").alias("k"))
    parts = scan.pieces(rows, by, [*order, "k"], _clamped(max_sources), "piece long, last boolean, shift long, lo long, hi long, shift0 long, lo0 long, hi0 long")
    held = lambda s, row: max(row[1], min(row[2], s + row[0]))
    entries = scan.entered(parts.where("last").select(by, "piece", "shift", "lo", "hi"), by, 1, lambda s, row: (s, held(s, row)))
    flat = parts.join(entries, [by, "piece"])
    live, was = (F.least(hi, F.greatest(lo, F.col("entry") + F.col(shift))) for shift, lo, hi in (("shift", "lo", "hi"), ("shift0", "lo0", "hi0")))
    flat = flat.select(by, *order, "k", "piece", live.alias("live"), was.alias("was")).withColumn("opened", (F.col("live") > F.col("was")).cast("long"))
    flat = running_sum(flat, [by], "piece", [*order, "k"], "opened", "ids")
    reply = F.when(F.col("opened") == 1, "opened").when(F.col("k") == 1, "source_limit").when(F.col("live") < F.col("was"), "closed").when(F.col("k") == -1, "source_not_found").otherwise("none")
    return flat.select(by, order[-1], "live", F.when(F.col("opened") == 1, F.col("ids")).alias("source_id"), reply.alias("reply"))
