"""Streaming twin of prior games and recent form: a keyed state, updated after it is read."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "match_id string, puuid string, seq long, games long, wins long, recent_games long, recent_wins long"


def prior_form(stream: DataFrame, window: int = 10) -> DataFrame:
    """For each row (match_id, puuid, seq, win) of a stream, what was known of the player before it.

    Rows of a player must come in order of seq over the batches; within a batch they are sorted.
    """

    def read_then_write(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        games, wins, recent = state.get if state.exists else (0, 0, "")
        rows = pd.concat(list(batches)).sort_values(["seq", "match_id"])
        out = []
        for r in rows.itertuples():
            out.append((r.match_id, key[0], r.seq, games, wins, len(recent), recent.count("1")))
            games, wins, recent = games + 1, wins + int(r.win), (recent + str(int(r.win)))[-window:]
        state.update((games, wins, recent))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return stream.select("match_id", "puuid", "seq", "win").groupBy("puuid").applyInPandasWithState(read_then_write, OUT, "games long, wins long, recent string", "append", GroupStateTimeout.NoTimeout)
