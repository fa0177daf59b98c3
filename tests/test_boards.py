"""Board features on hand-made positions, and the attack map against a square-by-square walk."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from crowdgap.functions import boards as bd
from crowdgap.operators import boards as bo

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def one(spark, fen, uci):
    df = spark.createDataFrame([(fen, uci)], "fen string, uci string")
    rows = bo.move_features(df).collect()
    return rows[0] if rows else None


def sq(name):
    return (8 - int(name[1])) * 8 + ord(name[0]) - 97


def slow_attackers(board, target, white):
    n = 0
    tr, tf = divmod(target, 8)
    for s, c in enumerate(board):
        if c == "." or c.isupper() != white or s == target:
            continue
        r, f = divmod(s, 8)
        dr, df = tr - r, tf - f
        k = c.lower()
        if k == "n":
            ok = abs(dr * df) == 2
        elif k == "k":
            ok = max(abs(dr), abs(df)) == 1
        elif k == "p":
            ok = abs(df) == 1 and dr == (-1 if white else 1)
        else:
            line, diag = dr == 0 or df == 0, abs(dr) == abs(df)
            ok = (line and k in "rq") or (diag and k in "bq")
            if ok:
                d = max(abs(dr), abs(df))
                ok = all(board[(r + dr // d * i) * 8 + f + df // d * i] == "." for i in range(1, d))
        n += ok
    return n


def test_attack_map_matches_walk(spark):
    rnd = random.Random(5)
    boards = ["".join(rnd.choice("PNBRQKpnbrqk" + "." * rnd.choice([4, 20, 60])) for _ in range(64))
              for _ in range(60)]
    rows = spark.createDataFrame([(b,) for b in boards], "b string").select(
        "b", bd.attack_map("b").alias("m")).collect()
    for r in rows:
        for t in range(64):
            assert ord(r.m.w[t]) - 48 == slow_attackers(r.b, t, True)
            assert ord(r.m.b[t]) - 48 == slow_attackers(r.b, t, False)


def test_expansion_and_start(spark):
    r = one(spark, START, "e2e4")
    assert len(r.board) == 64 and r.board[sq("e1")] == "K" and r.board[sq("d8")] == "q"
    assert r.quiet and r.advance and r.advance2plus and not r.is_capture
    assert r.piece_name == "pawn" and r.phase == "opening" and not r.endgame
    assert r.our_material == r.their_material == 39


def test_en_passant_counts_as_capture_only_in_one_definition(spark):
    r = one(spark, "4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 30", "e5d6")
    assert r.capture and not r.is_capture and r.quiet and not r.quiet_ep
    assert r.next_board[sq("d5")] == "." and r.next_board[sq("d6")] == "P"


def test_promotion_gives_check_with_the_new_piece(spark):
    r = one(spark, "4k3/P7/8/8/8/8/8/4K3 w - - 0 40", "a7a8q")
    assert r.next_board[sq("a8")] == "Q" and r.gives_check and not r.quiet
    assert not one(spark, "4k3/P7/8/8/8/8/8/4K3 w - - 0 40", "a7a8n").gives_check


def test_castling_moves_the_rook(spark):
    r = one(spark, "3k4/8/8/8/8/8/8/R3K3 w Q - 0 40", "e1c1")
    assert r.next_board[sq("d1")] == "R" and r.next_board[sq("a1")] == "." and r.gives_check


def test_discovered_check_and_blocked_slider(spark):
    assert one(spark, "4k3/8/8/8/4N3/8/8/K3R3 w - - 0 40", "e4c5").gives_check
    assert not one(spark, "4k3/4p3/8/8/4N3/8/8/K3R3 w - - 0 40", "e4c5").gives_check


def test_king_ring_in_the_corner(spark):
    r = one(spark, "k7/8/8/8/8/8/8/K6r w - - 0 40", "a1a2")
    assert r.in_check and r.pressure_before == 1 and r.king_walk is False


def test_threat_and_en_prise(spark):
    # knight fork of an undefended rook; the landing square is attacked by a pawn
    r = one(spark, "4k3/8/1p6/8/2N5/8/r7/4K3 w - - 0 40", "c4a5")
    assert r.lands_en_prise and r.att_by_lesser_after and r.offers_material
    assert r.to_pawn_attackers == 1 and r.to_pawn_attacked and r.into_attack
    s = one(spark, "4k3/8/8/8/8/2N5/8/r3K3 w - - 0 40", "c3b3")
    assert s is not None and s.sideways


@pytest.mark.parametrize("fen,uci", [(START, "e5e6"), (START, "e7e5"), (START, "zz"),
                                     ("not a board w - - 0 1", "e2e4")])
def test_unplayable_rows_are_dropped(spark, fen, uci):
    assert one(spark, fen, uci) is None


def test_phase_threshold_moves(spark):
    df = spark.createDataFrame([(START.replace(" 0 1", " 0 11"),)], "fen string")
    got = bo.with_board(df).select(bd.phase("board", "fullmove", 10).alias("a"),
                                   bd.phase("board", "fullmove", 12).alias("b")).first()
    assert (got.a, got.b) == ("middlegame", "opening")


def test_rim_and_toward_king(spark):
    r = one(spark, "4k3/8/8/8/8/8/8/4K2R w - - 0 40", "h1h7")
    assert r.to_rim and r.toward_their_king and r.long_move and r.endgame


def test_attack_maps_count_like_a_walk_over_the_squares_and_cost_little():
    rng = np.random.default_rng(4)
    boards = pd.Series(["".join(r) for r in rng.choice(list("PpNnBbRrQqKk........"), (10_000, 64))])
    took = []
    for _ in range(3):
        start = time.process_time()
        got = bd._attack_map(boards, pd.Series(rng.integers(0, 64, len(boards))))
        took.append(time.process_time() - start)
    assert min(took) < 0.2          # 0.44 s when every square was a number of its own

    def attackers(b, sq, white):
        found = []
        for q in range(64):
            kind = b[q].lower()
            if b[q] == "." or b[q].isupper() != white:
                continue
            forward = -1 if white else 1
            moves = {"p": [(forward, -1), (forward, 1)], "n": bd.JUMPS, "b": bd.DIAGONAL,
                     "r": bd.STRAIGHT}.get(kind, bd.STRAIGHT + bd.DIAGONAL)
            for dr, df in moves:
                for i in range(1, 8 if kind in "bqr" else 2):
                    r, f = q // 8 + dr * i, q % 8 + df * i
                    if not (0 <= r < 8 and 0 <= f < 8):
                        break
                    if r * 8 + f == sq:
                        found.append(bd.VALUES[kind])
                    if b[r * 8 + f] != ".":
                        break
        return found

    for i in range(20):
        for sq in range(64):
            for name in "wb":
                want = attackers(boards[i], sq, name == "w")
                assert ord(got[name][i][sq]) - 48 == len(want)
                assert got[name + "_low"][i][sq] == (chr(48 + min(want)) if want else "~")
