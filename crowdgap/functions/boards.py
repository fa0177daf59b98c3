"""Chess board strings as Catalyst expressions.

A board is a 64-character text, a8 first and h1 last, ``.`` for an empty square; a square is
its 0-based place in that text. The attack map of a board is text of the same shape: one
character per square and side. It comes from one Arrow-batched helper (:func:`attack_map`);
every question asked of it is again a text expression on the row, so features need no explode,
join or shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdgap.functions.measures import col

# Letters and exchange values.
PIECES = "PNBRQK"
NAMES = {"p": "pawn", "n": "knight", "b": "bishop", "r": "rook", "q": "queen", "k": "king"}
VALUES = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9, "k": 0}
STRAIGHT = [(0, 1), (1, 0), (0, -1), (-1, 0)]
DIAGONAL = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
JUMPS = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]


# ---------------------------------------------------------------- geometry, built by rule

def _on(r: int, f: int) -> bool:
    return 0 <= r < 8 and 0 <= f < 8


def _steps(sq: int, moves) -> list[int]:
    r, f = divmod(sq, 8)
    return [(r + a) * 8 + f + b for a, b in moves if _on(r + a, f + b)]


def _squares_table(moves) -> Column:
    return F.array(*[F.array(*[F.lit(s) for s in _steps(q, moves)]).cast("array<int>")
                     for q in range(64)])


# ---------------------------------------------------------------- parsing

def _field(fen, n: int) -> Column:
    return F.split_part(col(fen), F.lit(" "), F.lit(n))


def side(fen) -> Column:
    return _field(fen, 2)


def fullmove(fen) -> Column:
    return _field(fen, 6).try_cast("int")


def board(fen) -> Column:
    """First FEN field with its digits written out and row breaks removed."""
    text = F.replace(_field(fen, 1), F.lit("/"), F.lit(""))
    return reduce(lambda t, n: F.replace(t, F.lit(str(n)), F.lit("." * n)), range(1, 9), text)


def square(name) -> Column:
    """Square number of ``e4`` style text."""
    name = col(name)
    return (8 - F.substring(name, 2, 1).try_cast("int")) * 8 + F.ascii(name) - 97


def en_passant_square(fen) -> Column:
    field = _field(fen, 4)
    return F.when(F.length(field) == 2, square(field))


def at(b, sq) -> Column:
    return F.substr(col(b), col(sq) + 1, F.lit(1))


def rank_row(sq) -> Column:
    """0 is the eighth rank."""
    return F.floor(col(sq) / 8).cast("int")


def file(sq) -> Column:
    return (col(sq) % 8).cast("int")


def chebyshev(a, b) -> Column:
    return F.greatest(F.abs(rank_row(a) - rank_row(b)), F.abs(file(a) - file(b)))


def value_of(piece) -> Column:
    low = F.lower(piece)
    chain = F.when(low == "p", 1)
    for letter in "nbrqk":
        chain = chain.when(low == letter, VALUES[letter])
    return chain.otherwise(0)


def name_of(piece) -> Column:
    low = F.lower(piece)
    chain = F.when(low == "p", NAMES["p"])
    for letter in "nbrqk":
        chain = chain.when(low == letter, NAMES[letter])
    return chain.otherwise("?")


def count_of(b, letters: str) -> Column:
    # texts without a letter are searched by bytes; F.translate looks up every character
    rest = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), letters, col(b))
    return F.length(col(b)) - F.length(rest)


def phase(b, full, opening_max: int = 12) -> Column:
    """At most six pieces besides pawns and kings: endgame; else early moves: opening."""
    return F.when(count_of(b, "NBRQnbrq") <= 6, "endgame").when(
        col(full) <= opening_max, "opening").otherwise("middlegame")


def material(b, white: bool) -> Column:
    letters = PIECES if white else PIECES.lower()
    return sum((count_of(b, c) * VALUES[c.lower()] for c in letters if VALUES[c.lower()]),
               F.lit(0))


def is_own(piece, mover) -> Column:
    """Does this letter belong to the side ``w`` or ``b``?"""
    white = piece.between("A", "Z")
    return F.when(col(mover) == "w", white).otherwise(piece.between("a", "z"))


# ---------------------------------------------------------------- attack map

# A set of squares is a 64-bit number for each board, square i at bit i.

def _bits(marks: np.ndarray) -> np.ndarray:
    """Boards x 64 truth values as sets."""
    return np.packbits(marks, axis=1, bitorder="little").view("<u8").ravel()


def _squares(sets: np.ndarray) -> np.ndarray:
    """Sets as boards x 64 zeros and ones."""
    return np.unpackbits(np.ascontiguousarray(sets, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")


def _shift(plane: np.ndarray, move) -> np.ndarray:
    """Move sets by rows and files; what leaves the board is lost."""
    dr, df = move
    kept = sum(1 << q for q in range(64) if 0 <= q % 8 + df < 8)
    by = 8 * dr + df
    plane = plane & np.uint64(kept)
    return plane << np.uint64(by) if by > 0 else plane >> np.uint64(-by)


def _reach(kind: str, white: bool, plane: np.ndarray, empty: np.ndarray) -> list[np.ndarray]:
    """The squares that pieces of a plane attack, one set for each direction.

    In one direction a square has one attacker at most: the first piece met hides all behind it.
    """
    if kind in "bqr":
        out = []
        for move in (DIAGONAL if kind != "r" else []) + (STRAIGHT if kind != "b" else []):
            front = met = _shift(plane, move)
            for _ in range(6):
                front = _shift(front & empty, move)
                met = met | front
            out.append(met)
        return out
    forward = -1 if white else 1
    moves = {"p": [(forward, -1), (forward, 1)], "n": JUMPS, "k": STRAIGHT + DIAGONAL}[kind]
    return [_shift(plane, move) for move in moves]


def _count(digits: list[np.ndarray], hits: np.ndarray) -> None:
    """Add one on the squares of a set; ``digits`` are the binary digits of all squares' counts."""
    for i, d in enumerate(digits):
        digits[i], hits = d ^ hits, d & hits


_MAP = "w string, b string, w_low string, b_low string, top_target int, loose_target boolean"


def _attack_map(boards: pd.Series, origin: pd.Series) -> pd.DataFrame:
    n = len(boards)
    grid = np.frombuffer("".join(boards).encode("ascii"), dtype=np.uint8).reshape(n, 64)
    empty = _bits(grid == ord("."))
    start = origin.fillna(-1).to_numpy().astype(int)
    here = np.where((start >= 0) & (start < 64), np.uint64(1) << (start % 64).astype(np.uint64),
                    np.uint64(0))
    aims = np.zeros(n, np.uint64)
    worth: dict[int, np.ndarray] = {}
    attacked, out = {}, {}
    for name, white in (("w", True), ("b", False)):
        digits = [np.zeros(n, np.uint64) for _ in range(5)]     # 16 attackers at most
        seen, low = np.zeros(n, np.uint64), np.full((n, 64), ord("~"), np.uint8)
        for kind, value in sorted(VALUES.items(), key=lambda e: e[1]):
            plane = _bits(grid == ord(kind.upper() if white else kind))
            if not plane.any():
                continue
            worth[value] = worth.get(value, np.uint64(0)) | plane
            every = np.zeros(n, np.uint64)
            for hits in _reach(kind, white, plane, empty):
                _count(digits, hits)
                every |= hits
            low -= _squares(every & ~seen) * np.uint8(ord("~") - 48 - value)
            seen |= every
            mine = plane & here
            if mine.any():
                for hits in _reach(kind, white, mine, empty):
                    aims |= hits
        attacked[name], out[name + "_low"] = seen, low
        out[name] = sum((_squares(d) << np.uint8(i) for i, d in enumerate(digits)), np.uint8(48))
    upper = _bits((grid >= ord("A")) & (grid <= ord("Z")))
    ours = (upper & here) != 0
    enemy = np.where(ours, ~upper & ~empty, upper) & aims
    guarded = np.where(ours, attacked["b"], attacked["w"])
    top = np.where(enemy != 0, 0, -1)
    for value in sorted(worth):
        top[(enemy & worth[value]) != 0] = value

    def text(planes):
        flat = np.ascontiguousarray(planes, np.uint8).view("S64").ravel()
        return [x.decode("ascii") for x in flat]

    return pd.DataFrame({
        "w": text(out["w"]), "b": text(out["b"]), "w_low": text(out["w_low"]),
        "b_low": text(out["b_low"]), "top_target": top.astype(np.int32),
        "loose_target": (enemy & ~guarded) != 0})


def attack_map(b, origin=None) -> Column:
    """Attack map of a 64-character board.

    ``w`` and ``b`` hold the number of attackers per square as ``chr(48 + n)``, ``w_low`` and
    ``b_low`` the value of the cheapest one (``~`` when there is none). For the piece on
    ``origin``: the most valuable opposing piece it attacks (-1: none), and whether it attacks
    an opposing piece nobody guards.
    """
    return F.pandas_udf(_attack_map, _MAP)(col(b), F.lit(-1) if origin is None else col(origin).cast("int"))


def _side_text(attacks, mover, by_mover: bool, suffix: str = "") -> Column:
    a = col(attacks)
    white, black = a["w" + suffix], a["b" + suffix]
    first, second = (white, black) if by_mover else (black, white)
    return F.when(col(mover) == "w", first).otherwise(second)


def attackers(attacks, sq, mover, by_mover: bool) -> Column:
    """Number of the mover's (or the opponent's) pieces attacking a square."""
    return F.ascii(at(_side_text(attacks, mover, by_mover), sq)) - 48


def attacked_by_cheaper(attacks, sq, mover, limit) -> Column:
    """Does the opponent attack a square with a piece worth less than ``limit``?

    A king is worth 0, so it always qualifies.
    """
    return F.ascii(at(_side_text(attacks, mover, False, "_low"), sq)) - 48 < col(limit)


def pawn_attackers(b, sq, mover) -> Column:
    """Number of the opponent's pawns attacking a square."""
    from_above = F.get(_squares_table([(-1, -1), (-1, 1)]), col(sq))
    from_below = F.get(_squares_table([(1, -1), (1, 1)]), col(sq))
    black = F.size(F.filter(from_above, lambda s: at(b, s) == "p"))
    white = F.size(F.filter(from_below, lambda s: at(b, s) == "P"))
    return F.when(col(mover) == "w", black).otherwise(white)


def ring_pressure(attacks, king_sq, mover) -> Column:
    """Attackers of the opponent summed over the squares around the mover's king."""
    text = _side_text(attacks, mover, False)
    ring = F.get(_squares_table(STRAIGHT + DIAGONAL), col(king_sq))
    total = F.aggregate(ring, F.lit(0), lambda acc, s: acc + F.ascii(at(text, s)) - 48)
    return F.coalesce(total, F.lit(0))


# ---------------------------------------------------------------- moves

def put(b: Column, sq: Column, letter: Column) -> Column:
    return F.overlay(b, letter, sq + 1)


def after_move(b, mover, frm, to, promotion, ep_sq) -> Column:
    """Board after the move: captures, promotion, en passant and the castling rook."""
    b, frm, to = col(b), col(frm), col(to)
    piece = at(b, frm)
    promoted = F.when(col(mover) == "w", F.upper(col(promotion))).otherwise(
        F.lower(col(promotion)))
    landed = F.when(F.length(col(promotion)) == 1, promoted).otherwise(piece)
    moved = put(put(b, frm, F.lit(".")), to, landed)
    taken = rank_row(frm) * 8 + file(to)
    moved = F.when(is_en_passant(b, frm, to, ep_sq), put(moved, taken, F.lit("."))).otherwise(moved)
    jump = file(to) - file(frm)
    castles = ((F.lower(piece) == "k") & (file(frm) == 4) & (F.abs(jump) == 2)
               & (rank_row(frm) == rank_row(to)))
    rook = F.when(col(mover) == "w", "R").otherwise("r")
    corner = rank_row(frm) * 8 + F.when(jump > 0, 7).otherwise(0)
    inner = rank_row(frm) * 8 + F.when(jump > 0, 5).otherwise(3)
    return F.when(castles & (at(b, corner) == rook),
                  put(put(moved, corner, F.lit(".")), inner, rook)).otherwise(moved)


def is_en_passant(b, frm, to, ep_sq) -> Column:
    b, frm, to = col(b), col(frm), col(to)
    return F.coalesce((col(ep_sq) == to) & (F.lower(at(b, frm)) == "p")
                      & (F.abs(file(frm) - file(to)) == 1)
                      & (F.abs(rank_row(frm) - rank_row(to)) == 1)
                      & (at(b, to) == "."), F.lit(False))


def king_square(b, mover, own: bool = True) -> Column:
    """Square of a side's king, NULL when the board has none."""
    letter = F.when((col(mover) == "w") == F.lit(own), "K").otherwise("k")
    return F.nullif(F.instr(col(b), letter), F.lit(0)) - 1
