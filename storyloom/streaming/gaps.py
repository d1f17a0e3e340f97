"""An extension: the largest gap of each key kept up to date while scenes arrive.

State is five numbers a key, whatever the stream's length; Spark keeps it in its state store and checkpoints it. Scenes of a
key are expected in order; one that is not later than the last seen is counted and otherwise left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity string, freq long, late long, last_scene long, gap_jump long, scene_a long, scene_b long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    freq, late, last, gap, a, b = state.get if state.exists else (0, 0, -1, -1, -1, -1)
    for scene in sorted(int(s) for batch in batches for s in batch["scene_idx"]):
        if freq and scene <= last:
            late += scene < last
            continue
        if freq and scene - last > gap:
            gap, a, b = scene - last, last, scene
        freq, last = freq + 1, scene
    state.update((freq, late, last, gap, a, b))
    yield pd.DataFrame([(key[0], freq, late, last, gap, a, b)], columns=["entity", "freq", "late", "last_scene", "gap_jump", "scene_a", "scene_b"])


def running_gaps(mentions: DataFrame) -> DataFrame:
    """From a stream ``mentions(entity, scene_idx)`` the state of each entity that changed; a gap of -1 means one scene so far."""
    return mentions.groupBy("entity").applyInPandasWithState(
        _update, OUT, "freq long, late long, last_scene long, gap_jump long, scene_a long, scene_b long", "update", GroupStateTimeout.NoTimeout
    )
