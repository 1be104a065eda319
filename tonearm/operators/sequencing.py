"""Greedy ordering of candidates along a target curve, and the part of each track that is played."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of the ordering cost.
BPM_WEIGHT, LUFS_WEIGHT, SCORE_WEIGHT, CLASH, ARTIST, ARTIST_WINDOW, KEY_RUN = 1.0, 1.5, 8.0, 25.0, 15.0, 3, 2.0


def _parse(code: str | None) -> tuple[int, str] | None:
    code = (code or "").strip().upper()
    if len(code) < 2 or code[-1] not in "AB" or not code[:-1].isdigit() or not 1 <= int(code[:-1]) <= 12:
        return None
    return int(code[:-1]), code[-1]


def _key_cost(a: str | None, b: str | None) -> float:
    x, y = _parse(a), _parse(b)
    if x is None or y is None:
        return 0.0
    step, same = min((x[0] - y[0]) % 12, (y[0] - x[0]) % 12), x[1] == y[1]
    if step == 0:
        return 0.0 if same else 1.0
    return 1.0 if same and step == 1 else CLASH


ORDER = "set_id long, i int, path string"


def greedy(cards: DataFrame, n: int | None = None) -> DataFrame:
    """(set_id, i, path): slot by slot the unused card of least cost for the curve's target there, ties to the card first by ``i``.

    ``cards`` has (set_id, i, path, artist, camelot, bpm, lufs, score) and a curve as arrays (``xs``, ``bpms``, ``lufss``), one bounded candidate pool a set; each choice
    depends on the ones before, so a set is ordered within one task and sets run side by side.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pool = pool.sort_values("i", kind="stable").reset_index(drop=True)
        size = len(pool) if n is None else min(n, len(pool))
        xs, bs, ls = (np.asarray(pool[c].iat[0], dtype=float) for c in ("xs", "bpms", "lufss"))
        bpm, lufs, score = (pool[c].to_numpy(dtype=float) for c in ("bpm", "lufs", "score"))
        free, chosen = np.ones(len(pool), dtype=bool), []
        keys, artists = pool["camelot"].tolist(), pool["artist"].fillna("").tolist()
        for k in range(size):
            x = k / (size - 1) if size > 1 else 0.0
            cost = BPM_WEIGHT * np.abs(bpm - np.interp(x, xs, bs)) + LUFS_WEIGHT * np.abs(lufs - np.interp(x, xs, ls)) - SCORE_WEIGHT * score
            if chosen:
                last = keys[chosen[-1]]
                cost = cost + np.array([_key_cost(last, c) for c in keys])
                for back in range(1, min(ARTIST_WINDOW, len(chosen)) + 1):
                    who = artists[chosen[-back]]
                    if who:
                        cost = cost + np.array([ARTIST / back if a == who else 0.0 for a in artists])
                run_length = 0
                while run_length < len(chosen) and keys[chosen[-1 - run_length]] == last:
                    run_length += 1
                if run_length >= 2:
                    cost = cost + np.array([KEY_RUN * (run_length - 1) if c == last else 0.0 for c in keys])
            cost[~free] = np.inf
            best = int(np.nanargmin(cost))
            free[best] = False
            chosen.append(best)
        return pd.DataFrame({"set_id": pool["set_id"].iat[0], "i": range(size), "path": pool["path"].to_numpy()[chosen]})

    return cards.groupBy("set_id").applyInPandas(run, ORDER)


def play_spans(sections: DataFrame, slots: DataFrame, min_play: float = 120.0, max_play: float = 330.0) -> DataFrame:
    """Each slot (slot_id, track_id, target_lufs) with its core, entry and exit section.

    The core's energy is nearest to the target (lowest idx on ties). The entry is a mix-in section up to it, the exit a mix-out section from it on, or the core where none is
    flagged; the pair fills the play window best. A track has few sections, so pairs of them stay few. Slots without a section of known energy are left out.
    """
    s = sections.dropDuplicates(["id"]).select("track_id", "idx", "label", "start_s", "end_s", "energy_lufs", "is_mixin", "is_mixout")
    j = slots.join(s, "track_id")
    known = j.where(F.col("energy_lufs").isNotNull() & ~F.isnan("energy_lufs"))
    core = known.groupBy("slot_id").agg(F.min_by(F.struct("idx", "label", "start_s", "end_s", F.col("energy_lufs").alias("lufs")), F.struct(F.abs(F.col("energy_lufs") - F.col("target_lufs")), "idx")).alias("core"))
    part = F.struct("idx", "label", "start_s", "end_s")
    c = j.join(core, "slot_id")
    flagged = c.groupBy("slot_id").agg(
        F.first("core").alias("core"),
        F.array_sort(F.collect_list(F.when(F.col("is_mixin") & (F.col("idx") <= F.col("core.idx")), part))).alias("entries"),
        F.array_sort(F.collect_list(F.when(F.col("is_mixout") & (F.col("idx") >= F.col("core.idx")), part))).alias("exits"),
    )
    own = F.array(F.struct("core.idx", "core.label", "core.start_s", "core.end_s"))
    flagged = flagged.withColumns({"entries": F.when(F.size("entries") > 0, F.col("entries")).otherwise(own), "exits": F.when(F.size("exits") > 0, F.col("exits")).otherwise(own)})
    pairs = flagged.select("slot_id", "core", F.explode("entries").alias("e"), "exits").select("slot_id", "core", "e", F.explode("exits").alias("x"))
    span = F.col("x.end_s").cast("double") - F.col("e.start_s").cast("double")
    tier = F.when(span <= 0, 2).when((span < min_play) | (span > max_play), 1).otherwise(0)
    cost = F.when(span <= 0, 0.0).when(span < min_play, min_play - span).when(span > max_play, span - max_play).otherwise(max_play - span)
    best = pairs.groupBy("slot_id").agg(F.first("core").alias("core"), F.min_by(F.struct("e", "x"), F.struct(tier, cost, F.col("e.idx"), F.col("x.idx"))).alias("b"))
    return best.select(
        "slot_id", F.col("core.idx").cast("int").alias("section_idx"), F.col("core.label").alias("section_label"), F.col("core.lufs").cast("double").alias("lufs"),
        F.col("b.e.start_s").cast("double").alias("cue_start_s"), F.col("b.x.end_s").cast("double").alias("cue_end_s"), F.col("b.e.label").alias("mixin_label"), F.col("b.x.label").alias("mixout_label"),
        F.when(F.col("core.start_s") > F.col("b.e.start_s"), F.col("core.start_s").cast("double")).alias("core_start_s"),
    )
