"""Measures, predicates and verdicts as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds the study is defined by.
GAP = 100.0            # cost from which the expert choice counts as clearly better
P_INVISIBLE = 0.05     # crowd probability up to which a choice counts as invisible
P_VISIBLE = 0.30
MATE_SCORE = 2000
REPORT_EDGES = [0, 2000, 2200, 2400, 2600, 2800, 4000]
REPORT_LABELS = ["<2000", "2000-2200", "2200-2400", "2400-2600", "2600-2800", "2800+"]
VALUE_EDGES = [0, 2000, 2300, 2600, 2800, 4000]
VALUE_LABELS = ["<2000", "2000-2300", "2300-2600", "2600-2800", "2800+"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """Spark orders NaN above every number, so thresholds would accept it."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def mean_of(flag) -> Column:
    """Share of rows where a boolean (or 0/1) column holds."""
    return F.avg(col(flag).cast("double"))


def rounded(c, digits: int = 6) -> Column:
    return F.round(col(c), digits) + F.lit(0.0)


def rating_number(c) -> Column:
    """Missing counts as 0, unparseable gives NULL."""
    return F.coalesce(col(c), F.lit("0")).try_cast("int")


def base_time(c) -> Column:
    """Seconds before the '+' of a time control such as ``600+5``."""
    return F.split(F.coalesce(col(c), F.lit("0+0")), r"\+")[0].try_cast("int")


def game_id(site, fallback, empty_too: bool = True) -> Column:
    """Last URL segment; the fallback applies to a missing tag and, by default, an empty one."""
    tail = F.element_at(F.split(col(site), "/"), -1)
    return F.coalesce(F.nullif(tail, F.lit("")) if empty_too else tail, col(fallback))


def pov_score(cp, mate, side) -> Column:
    """White-relative score seen from the mover; mate in n scores 2000 - n either way."""
    mate = col(mate)
    white = F.when(mate.isNull(), col(cp)).when(
        mate > 0, F.lit(MATE_SCORE) - mate).otherwise(-F.lit(MATE_SCORE) - mate)
    return F.when(col(side) == "w", white).otherwise(-white).cast("double")


def margin(best_cp, second_cp) -> Column:
    """Lead of the best option; a missing runner-up means no lead."""
    return col(best_cp) - F.coalesce(col(second_cp), col(best_cp))


def crowd_cost(best, favourite, best_cp, favourite_cp) -> Column:
    """0 when the crowd agrees, NULL when its favourite was not scored."""
    return F.when(col(favourite) == col(best), F.lit(0.0)).otherwise(
        nan_to_null(col(best_cp) - col(favourite_cp)))


def p_max(levels: Sequence[str]) -> Column:
    return F.greatest(*[col(c) for c in levels])


def p_slope(levels: Sequence[str]) -> Column:
    return col(levels[-1]) - col(levels[0])


def disagreement(cost, pmax, gap: float = GAP, limit: float = P_INVISIBLE) -> Column:
    """Expert clearly right and invisible to the crowd; an unscored cost is never flagged."""
    return F.coalesce((nan_to_null(cost) >= gap) & (nan_to_null(pmax) <= limit), F.lit(False))


def mover_rating(side, white, black) -> Column:
    return F.when(col(side) == "w", col(white)).when(col(side) == "b", col(black))


def band(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals; outside all of them (or NULL) gives NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval expected")
    c = col(c)
    steps = [(lo, hi, lab) for lo, hi, lab in zip(edges, edges[1:], labels)]
    return reduce(lambda acc, s: acc.when((c > s[0]) & (c <= s[1]), s[2]), steps[1:],
                  F.when((c > steps[0][0]) & (c <= steps[0][1]), steps[0][2]))


def visibility(pmax) -> Column:
    p = col(pmax)
    return F.when(p <= P_INVISIBLE, "invisible").when(p >= P_VISIBLE, "visible").otherwise("mid")


def starkness(cost, pmax) -> Column:
    return col(cost) - 1000 * col(pmax)


def tier(p_best) -> Column:
    """1 is the easiest."""
    p = col(p_best)
    return F.when(p >= 0.02, 1).when(p >= 0.005, 2).otherwise(3)


def verdict_trend(delta) -> Column:
    d = col(delta)
    return F.when(d > 0.02, "RISING").when(d < -0.02, "FALLING").otherwise("FLAT")


def verdict_stability(ari) -> Column:
    a = col(ari)
    return F.when(a >= 0.6, "stable").when(a >= 0.4, "moderate").otherwise("unstable")


def verdict_significant(p_value) -> Column:
    return col(p_value) < 0.05


def verdict_gain(gain) -> Column:
    """Does an added feature block survive the control?"""
    return F.when(col(gain) > 0.01, "survives").otherwise("does not survive")


# The labels of the signature cascade.
FAMILY_NAMES = [
    "The unpaid sacrifice",
    "Walking into the fire",
    "Cold defence",
    "The pawn that isn't urgent",
    "Backwards on purpose",
    "Endgame against instinct",
    "Order of operations",
]


def family_name(motifs, top_motif, top_piece, quiet, pawn, retreat, endgame_share) -> Column:
    """First matching rule over a group's measured signature.

    ``motifs`` is a map from motif name to cosine; an absent motif counts as 0.
    """
    def cosine(name):
        return F.coalesce(col(motifs)[name], F.lit(0.0))

    quiet, pawn, retreat = col(quiet), col(pawn), col(retreat)
    rules = [
        (cosine("sacrifice") > 0.3) & (quiet > 0.75),
        cosine("exposedKing") > 0.35,
        (col(top_motif) == "defensiveMove") | ((cosine("defensiveMove") > 0.15) & (quiet > 0.75)),
        (pawn > 0.28) & (quiet > 0.8),
        retreat > 0.3,
        col(endgame_share) > 0.4,
        (cosine("intermezzo") > 0.18) | (cosine("clearance") > 0.18),
    ]
    chain = F.when(rules[0], FAMILY_NAMES[0])
    for rule, name in zip(rules[1:], FAMILY_NAMES[1:]):
        chain = chain.when(rule, name)
    return chain.otherwise(F.format_string("Quiet %s play", col(top_piece)))


def neutral_label(group_id) -> Column:
    return F.concat(F.lit("Concept "), (col(group_id) + 1).cast("string"))


def neutral_gloss(n, phase, quiet, piece, motif, cosine, found, cost) -> Column:
    """One checkable sentence per measured fact; two branches on the nearest motif."""
    # Sentence formats.
    none_near = ("it has no measurable similarity to any of the twelve named motifs — "
                 "the closest, %s, sits at %.2f")
    near = "this group is closest to %s (%.2f), and only weakly"
    text = ("%d positions, mostly %s. %.0f%% of the moves are quiet — neither capture nor check "
            "— and the piece moved is most often a %s. In the engine's representation %s. "
            "Real players at the board found these moves %.1f%% of the time, losing an average "
            "of %d centipawns by choosing otherwise.")
    nearest = F.when(col(cosine) <= 0.01, F.format_string(none_near, col(motif), col(cosine))) \
        .otherwise(F.format_string(near, col(motif), col(cosine)))
    return F.format_string(text, col(n).cast("bigint"), col(phase), col(quiet) * 100, col(piece),
                           nearest, col(found) * 100, F.round(col(cost)).cast("bigint"))
