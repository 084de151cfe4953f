"""Arrival-order assignment of occurrences to prototypes as a stateful stream.

State of a term: its buffered vectors until there are `buffer_size`, then the centres and thresholds of its prototypes: one where the
occurrences concentrate (or form no clusters), else one a cluster.  Later occurrences fit if their cosine with the nearest centre reaches its
threshold, else they are anomalies.  State holds a bounded buffer for each term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators import cluster
from spanloom.operators.prototypes import BUFFER, PERCENTILE, TAU

OUT = "term_id long, occ_id long, status string, sim double, sense int"


def train(x: np.ndarray, percentile: float = PERCENTILE, tau: float = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Centres and thresholds of a buffer."""
    rows = cluster.unit(x)

    def centre(own: np.ndarray) -> tuple[np.ndarray, float]:
        c = own.mean(axis=0)
        c /= max(float(np.linalg.norm(c)), 1e-12)
        return c, float(np.percentile(own @ c, (1 - percentile) * 100))

    one = centre(rows)
    if (rows @ one[0]).mean() <= tau:
        labels = cluster.labels_of(x, np.arange(len(x)), None, False)
        if labels.max() >= 0:
            found = [centre(rows[labels == k]) for k in range(labels.max() + 1)]
            return np.stack([c for c, _ in found]), np.array([t for _, t in found])
    return one[0][None], np.array([one[1]])


def assign_stream(occurrences: DataFrame, buffer_size: int = BUFFER, percentile: float = PERCENTILE) -> DataFrame:
    """occurrences: streaming (term_id long, occ_id long, embed array<double>); rows of a micro-batch are taken in the order of occ_id.

    Each occurrence comes out once: buffered, fits or anomaly, with the prototype (sense, from 0) it is nearest to.  Training happens at the end of the batch that fills the buffer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("occ_id")
        x = np.stack(rows["embed"].to_numpy()).astype(float)
        buffered, centres, limits = state.get if state.exists else (b"", b"", b"")
        sim, status, sense = np.full(len(x), np.nan), np.full(len(x), "buffered"), np.full(len(x), -1)
        if centres:
            t = np.frombuffer(limits)
            s = cluster.unit(x) @ np.frombuffer(centres).reshape(len(t), -1).T
            sense = np.round(s, 9).argmax(axis=1)
            sim = s[np.arange(len(x)), sense]
            status = np.where(sim >= t[sense], "fits", "anomaly")
        else:
            whole = np.concatenate([np.frombuffer(buffered).reshape(-1, x.shape[1]), x])
            if len(whole) >= buffer_size:
                c, t = train(whole, percentile)
                state.update((b"", c.tobytes(), t.tobytes()))
            else:
                state.update((whole.tobytes(), b"", b""))
        yield pd.DataFrame({"term_id": key[0], "occ_id": rows["occ_id"].to_numpy(), "status": status, "sim": sim, "sense": sense.astype(np.int32)})

    return occurrences.groupBy("term_id").applyInPandasWithState(step, OUT, "buffer binary, centres binary, thresholds binary", "append", GroupStateTimeout.NoTimeout)
