"""Lifeline tracking and trailing surprise with state between micro-batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators.themes import Lifelines

_OUT = "theme int, time int, rank int, score double, size int"
_SURPRISE = "ent string, time int, obs double, excess double, z double"


def _dump(state: Lifelines) -> str:
    lines = [[t, {**v, "members": sorted(v["members"])}] for t, v in state.known.items()]
    return json.dumps(lines)


def _load(text: str) -> Lifelines:
    return Lifelines(known={t: {**v, "members": set(v["members"])} for t, v in json.loads(text)})


def theme_weeks(clusters: DataFrame) -> DataFrame:
    """Streaming form of the fold: clusters (time, rank, score, members) arrive in week order, a micro-batch holding
    whole weeks. The state is the lifelines; it is as large as their members are."""

    def step(key, batches, state: GroupState):
        lines = _load(state.get[0]) if state.exists else Lifelines()
        rows = pd.concat(list(batches))
        out = []
        for t, week in rows.sort_values(["time", "rank"]).groupby("time"):
            found = [
                (int(r), float(s), [(m["ent"], m["excess"], m["prior_episodes"]) for m in ms])
                for r, s, ms in zip(week["rank"], week["score"], week["members"])
            ]
            out += lines.week(int(t), found)
        state.update((_dump(lines),))
        yield pd.DataFrame(out, columns=["theme", "time", "rank", "score", "size"])

    keyed = clusters.select("time", "rank", "score", "members", F.lit(1).alias("one"))
    return keyed.groupBy("one").applyInPandasWithState(step, _OUT, "lines string", "append", GroupStateTimeout.NoTimeout)


def surprise(counts: DataFrame, recent: int = 4, base: int = 26) -> DataFrame:
    """Streaming surprise of (ent, time, n): an entity's state is its counts of the last ``recent`` + ``base`` weeks.

    Weeks of an entity arrive in order; weeks in between are answered when the next one arrives.
    """
    keep = recent + base

    def step(key, batches, state: GroupState):
        last, window = state.get if state.exists else (-1, "[0]")
        window = json.loads(window)
        if len(window) != keep:
            window = [0.0] * keep
        out = []
        for t, n in pd.concat(list(batches)).groupby("time")["n"].sum().sort_index().items():
            first = int(t) if last < 0 else last + 1
            for w in range(first, int(t) + 1):
                window = window[1:] + [float(n) if w == t else 0.0]
                obs, before = sum(window[-recent:]), sum(window[:base])
                expected = before * recent / base
                if w >= keep and (obs or before):
                    out.append((key[0], w, obs, obs - expected, (obs - expected) / (expected + 1) ** 0.5))
            last = int(t)
        state.update((last, json.dumps(window)))
        yield pd.DataFrame(out, columns=["ent", "time", "obs", "excess", "z"])

    return counts.groupBy("ent").applyInPandasWithState(
        step, _SURPRISE, "last int, counts string", "append", GroupStateTimeout.NoTimeout
    )
