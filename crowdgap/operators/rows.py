"""Row-level operators: eligibility, grids, derived measures, flags, imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgap.functions import measures as m


def eligible_games(df: DataFrame, min_elo: int | None = 1800, min_base: int = 600,
                   white="white_elo", black="black_elo", time_control="time_control",
                   termination="termination") -> DataFrame:
    """Club rules, or (``min_elo=None``) the elite rule: both ratings parse.

    A missing rating counts as 0, a missing termination passes.
    """
    we, be = m.rating_number(white), m.rating_number(black)
    if min_elo is None:
        return df.where(we.isNotNull() & be.isNotNull())
    return df.where((we >= min_elo) & (be >= min_elo) & (m.base_time(time_control) >= min_base)
                    & ~F.col(termination).eqNullSafe(F.lit("Abandoned")))


def sample_grid(df: DataFrame, ply="ply", every: int = 4, lo: int = 14, hi: int = 70) -> DataFrame:
    p = m.col(ply)
    return df.where(p.between(lo, hi) & (p % every == 0))


def sample_side(df: DataFrame, side, wanted) -> DataFrame:
    """Keep the rows where the wanted side is to move."""
    return df.where(m.col(side) == m.col(wanted))


def derive_measures(df: DataFrame, levels: Sequence[str], best="best", best_cp="best_cp",
                    second_cp="second_cp", favourite="favourite",
                    favourite_cp="favourite_cp", gap: float = m.GAP,
                    limit: float = m.P_INVISIBLE) -> DataFrame:
    """Stored columns are rounded; the flag is decided on the unrounded values."""
    cost = m.crowd_cost(best, favourite, best_cp, favourite_cp)
    return df.withColumns({
        "engine_margin": m.margin(best_cp, second_cp),
        "flagged": m.disagreement(cost, m.p_max(levels), gap, limit),
        "cost": F.round(cost, 1) + F.lit(0.0),
        "p_max": F.round(m.p_max(levels), 4),
        "p_slope": F.round(m.p_slope(levels), 4) + F.lit(0.0),
    })


def flag_disagreement(df: DataFrame, levels: Sequence[str], cost="cost", gap: float = m.GAP,
                      limit: float = m.P_INVISIBLE, name: str = "flagged") -> DataFrame:
    return df.withColumn(name, m.disagreement(cost, m.p_max(levels), gap, limit))


def flag_hard_core(df: DataFrame, picked="picked", best="best", flagged="flagged") -> DataFrame:
    found = F.coalesce(m.col(picked) == m.col(best), F.lit(False))
    return df.withColumn("found", found).withColumn("hard_core", m.col(flagged) & ~found)


def control_set(df: DataFrame, p_top: str | None = None, flagged="flagged", cost="cost",
                min_cost: float = m.GAP, min_p: float = 0.2) -> DataFrame:
    """Unflagged rows; with ``p_top`` also costly ones the crowd already finds."""
    out = df.where(~m.col(flagged))
    if p_top is None:
        return out
    return out.where((m.col(cost) >= min_cost) & (m.col(p_top) >= min_p))


def eligible_items(df: DataFrame, best="best", deep_best="deep_best", deep_gap="deep_gap",
                   in_check="in_check", n_options="n_options", min_opts: int = 8,
                   min_gap: float = 70) -> DataFrame:
    """Teachable items: plain move, not in check, enough options, stable and clear when deeper."""
    return df.where((F.length(m.col(best)) == 4) & ~m.col(in_check)
                    & (m.col(n_options) >= min_opts) & (m.col(deep_best) == m.col(best))
                    & (m.col(deep_gap) >= min_gap))


def stability(df: DataFrame, best="best", deep_best="deep_best", mode: str = "flag") -> DataFrame:
    """``drop`` unstable rows, or ``flag`` them and keep everything."""
    stable = F.coalesce(m.col(deep_best) == m.col(best), F.lit(False))
    return df.where(stable) if mode == "drop" else df.withColumn("stable", stable)


def impute(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """NULL and NaN both become the block's default."""
    return df.withColumns({c: F.coalesce(m.nan_to_null(c), F.lit(float(v)))
                           for c, v in values.items()})


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def counterfactual(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.withColumn(column, F.lit(float(value)))
