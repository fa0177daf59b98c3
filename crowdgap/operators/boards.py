"""Readable features of a move, all row-local expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgap.functions import boards as bd
from crowdgap.functions.measures import col

# Names of the readable features, in report order.
READABLE = ["piece_pawn", "piece_minor", "piece_rook", "piece_queen", "piece_king", "is_capture",
            "captures_smaller", "gives_check", "quiet", "retreat", "deep_retreat", "advance2plus",
            "sideways", "long_move", "to_rim", "escapes_attack", "into_attack",
            "to_pawn_attacked", "lands_en_prise", "att_by_lesser_after", "offers_material",
            "creates_threat", "weakens_own_king", "king_walk", "toward_their_king",
            "material_down", "endgame"]


def with_board(df: DataFrame, fen: str = "fen") -> DataFrame:
    """Board text, side to move, full-move number and en-passant square from a FEN."""
    return df.withColumns({"board": bd.board(fen), "side": bd.side(fen),
                           "fullmove": bd.fullmove(fen), "ep_sq": bd.en_passant_square(fen)})


def with_move(df: DataFrame, uci: str = "uci") -> DataFrame:
    """From and to squares, promotion letter and the moving piece.

    A move text that does not parse leaves NULL squares.
    """
    ok = F.rlike(col(uci), F.lit("^[a-h][1-8][a-h][1-8][nbrq]?$"))
    return df.withColumns({
        "frm": F.when(ok, bd.square(F.substring(col(uci), 1, 2))),
        "dest": F.when(ok, bd.square(F.substring(col(uci), 3, 2))),
        "promotion": F.substring(col(uci), 5, 1),
    }).withColumn("piece", bd.at("board", "frm"))


def playable(df: DataFrame) -> DataFrame:
    """Drop rows whose board or move does not parse or whose from-square is not the mover's."""
    return df.where((F.length("board") == 64) & F.col("frm").isNotNull()
                    & F.coalesce(bd.is_own(F.col("piece"), "side"), F.lit(False)))


def move_geometry(df: DataFrame) -> DataFrame:
    """Direction and length of the move from the mover's view."""
    up = bd.rank_row("frm") - bd.rank_row("dest")
    df = df.withColumn("forward", F.when(F.col("side") == "w", up).otherwise(-up))
    d = F.col("forward")
    return df.withColumns({
        "advance": d > 0, "retreat": d < 0, "deep_retreat": d <= -2, "advance2plus": d >= 2,
        "sideways": d == 0, "long_move": bd.chebyshev("frm", "dest") >= 3,
        "to_rim": bd.file("dest").isin(0, 7) | bd.rank_row("dest").isin(0, 7)})


def piece_facts(df: DataFrame) -> DataFrame:
    """What moves and what it takes; ``capture`` counts en passant, ``is_capture`` does not."""
    low, target = F.lower("piece"), bd.at("board", "dest")
    taken = target != "."
    value, cap = bd.value_of(F.col("piece")), F.when(taken, bd.value_of(target)).otherwise(0)
    return df.withColumns({
        "piece_name": bd.name_of(F.col("piece")), "piece_pawn": low == "p",
        "piece_minor": low.isin("n", "b"), "piece_rook": low == "r", "piece_queen": low == "q",
        "piece_king": low == "k", "is_capture": taken,
        "capture": taken | bd.is_en_passant("board", "frm", "dest", "ep_sq"),
        "piece_value": value, "taken_value": cap, "captures_smaller": taken & (cap < value)})


def phase(df: DataFrame, opening_max: int = 12) -> DataFrame:
    heavy = bd.count_of("board", "NBRQnbrq")
    return df.withColumns({"phase": bd.phase("board", "fullmove", opening_max),
                           "endgame": heavy <= 6,
                           "king_walk": (F.lower("piece") == "k") & (heavy > 6)})


def material(df: DataFrame) -> DataFrame:
    white, black = bd.material("board", True), bd.material("board", False)
    mine = F.col("side") == "w"
    df = df.withColumns({"our_material": F.when(mine, white).otherwise(black),
                         "their_material": F.when(mine, black).otherwise(white)})
    return df.withColumn("material_down", F.col("our_material") < F.col("their_material") - 1)


def with_attacks(df: DataFrame) -> DataFrame:
    """Attack maps of the board before and after the move, in one Arrow pass."""
    df = df.withColumn("next_board", bd.after_move("board", "side", "frm", "dest", "promotion",
                                                   "ep_sq"))
    return df.withColumns({"now": bd.attack_map("board"),
                           "then": bd.attack_map("next_board", "dest")})


def attack_map(df: DataFrame) -> DataFrame:
    """Who attacks the from- and to-square before the move."""
    df = df.withColumns({"from_attackers": bd.attackers("now", "frm", "side", False),
                         "to_attackers": bd.attackers("now", "dest", "side", False),
                         "to_pawn_attackers": bd.pawn_attackers("board", "dest", "side")})
    hit_from, hit_to = F.col("from_attackers") > 0, F.col("to_attackers") > 0
    return df.withColumns({
        "escapes_attack": hit_from & ~hit_to, "into_attack": ~hit_from & hit_to,
        "to_pawn_attacked": (F.col("to_pawn_attackers") > 0) & (F.col("piece_value") > 1)})


def after_move(df: DataFrame) -> DataFrame:
    """Safety of the landed piece and the threats it makes."""
    value = F.col("piece_value")
    df = df.withColumns({
        "lands_en_prise": bd.attackers("then", "dest", "side", False)
        > bd.attackers("then", "dest", "side", True),
        "att_by_lesser_after": bd.attacked_by_cheaper("then", "dest", "side",
                                                      F.greatest(value, F.lit(1))),
        "creates_threat": (F.col("then.top_target") > value) | F.col("then.loose_target")})
    risky = F.col("lands_en_prise") | F.col("att_by_lesser_after")
    return df.withColumn("offers_material", risky & (F.col("taken_value") < value))


def check_flags(df: DataFrame) -> DataFrame:
    """In check before the move; giving check after it (discovered checks included)."""
    ours = bd.king_square("board", "side")
    theirs = bd.king_square("next_board", "side", own=False)
    df = df.withColumns({
        "in_check": F.coalesce(bd.attackers("now", ours, "side", False) > 0, F.lit(False)),
        "gives_check": F.coalesce(bd.attackers("then", theirs, "side", True) > 0,
                                  F.lit(False))})
    return df.withColumn("quiet", ~F.col("is_capture") & ~F.col("gives_check")).withColumn(
        "quiet_ep", ~F.col("capture") & ~F.col("gives_check"))


def king_pressure(df: DataFrame) -> DataFrame:
    """Pressure on the squares around the own king before and after; approach to the other."""
    before, after = bd.king_square("board", "side"), bd.king_square("next_board", "side")
    theirs = bd.king_square("board", "side", own=False)
    df = df.withColumns({"pressure_before": bd.ring_pressure("now", before, "side"),
                         "pressure_after": bd.ring_pressure("then", after, "side")})
    return df.withColumns({
        "weakens_own_king": F.col("pressure_after") > F.col("pressure_before"),
        "toward_their_king": F.coalesce(bd.chebyshev("dest", theirs) < bd.chebyshev("frm", theirs),
                                        F.lit(False))})


def mobility(df: DataFrame, n_legal: str = "n_legal", tension: str = "n_captures",
             replies: str = "n_replies") -> DataFrame:
    """Flags over supplied option counts (full move generation is not done here)."""
    return df.withColumns({"many_options": col(n_legal) >= 35, "high_tension": col(tension) >= 6,
                           "restricting": col(replies) < col(n_legal) * F.lit(0.85)})


def move_features(df: DataFrame, fen: str = "fen", uci: str = "uci") -> DataFrame:
    """Every feature above for the rows that can be played."""
    out = playable(with_move(with_board(df, fen), uci))
    for step in (move_geometry, piece_facts, phase, material, with_attacks, attack_map, after_move,
                 check_flags, king_pressure):
        out = step(out)
    return out.drop("now", "then")
