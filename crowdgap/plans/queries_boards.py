"""Board-string queries. Boards are derived from the orders table, one per row.

The SQL side shares nothing with the attack map: it walks the squares between each piece and
its target.
"""

from pyspark.sql import functions as F

from crowdgap.functions import boards as bd
from crowdgap.operators import boards as bo
from crowdgap.plans.bindings import read
from crowdgap.plans.registry import query
from crowdgap.session import materialise, parallelism

# letters given to the 16 hex digits, by key: crowded, open, heavy, pawns only
_ALPHABETS = ["PpNnBbRrQq......", "PNbrQq..........", "pBnRq...........", "Pp.............."]


def positions(spark, sf):
    """FEN and move per order; the board comes from two md5 texts, kings are placed apart."""
    key = F.col("o_orderkey")
    digest = F.concat(F.md5(key.cast("string")),
                      F.md5(F.concat(F.lit("b"), key.cast("string"))))
    raw = F.translate(digest, "0123456789abcdef", _ALPHABETS[0])
    for i in (1, 2, 3):
        raw = F.when(key % 4 == i, F.translate(digest, "0123456789abcdef", _ALPHABETS[i])) \
            .otherwise(raw)
    # the work per row is far larger than the row, so a few small columns are spread first
    keys = read(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(
        parallelism(spark), "o_orderkey")
    src = keys.select(
        key.alias("id"), F.col("o_custkey").alias("c"), raw.alias("raw"),
        (key % 64).cast("int").alias("wk"),
        ((key + 9 + F.col("o_custkey") % 46) % 64).cast("int").alias("bk"))
    src = src.withColumn("b", bd.put(bd.put(F.col("raw"), F.col("wk"), F.lit("K")),
                                     F.col("bk"), F.lit("k")))
    white = F.col("c") % 2 == 0
    shift = ((F.col("c") * 7) % 64).cast("int")
    turned = F.concat(F.substr("b", shift + 1), F.substr(F.col("b"), F.lit(1), shift))
    skip = F.when(white, F.length(F.regexp_extract(turned, "^[^PNBRQK]*", 0))).otherwise(
        F.length(F.regexp_extract(turned, "^[^pnbrqk]*", 0)))
    src = src.withColumn("f", ((shift + skip) % 64).cast("int"))
    src = src.withColumn("t", ((F.col("f") + 1 + F.col("c") % 63) % 64).cast("int"))

    def name(sq):
        return F.concat(F.substr(F.lit("abcdefgh"), F.col(sq) % 8 + 1, F.lit(1)),
                        (8 - F.floor(F.col(sq) / 8)).cast("string"))

    rows = [F.substr(F.col("b"), F.lit(8 * i + 1), F.lit(8)) for i in range(8)]
    text = F.concat_ws("/", *rows)
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    ep = F.when(F.col("id") % 3 == 0, name("t")).otherwise("-")
    fen = F.concat_ws(" ", text, F.when(white, "w").otherwise("b"), F.lit("-"), ep, F.lit("0"),
                      (1 + F.col("c") % 40).cast("string"))
    made = src.select("id", fen.alias("fen"), F.concat(name("f"), name("t")).alias("uci"))
    # games are stored with their FEN; without this cut the made-up text would be recomputed
    # for every use of the column
    return materialise(made, "boards")


_POS = f"""p0 AS (SELECT o_orderkey AS id, o_custkey AS c, translate(concat(
  md5(CAST(o_orderkey AS STRING)), md5(concat('b', o_orderkey))), '0123456789abcdef',
  CASE o_orderkey % 4 WHEN 0 THEN '{_ALPHABETS[0]}' WHEN 1 THEN '{_ALPHABETS[1]}'
  WHEN 2 THEN '{_ALPHABETS[2]}' ELSE '{_ALPHABETS[3]}' END) AS raw, o_orderkey % 64 AS wk,
  (o_orderkey + 9 + o_custkey % 46) % 64 AS bk FROM orders),
 p1 AS (SELECT id, c, concat(left(x, bk::INT), 'k', substr(x, bk::INT + 2)) AS board FROM
  (SELECT *, concat(left(raw, wk::INT), 'K', substr(raw, wk::INT + 2)) AS x FROM p0)),
 p2 AS (SELECT *, c % 2 = 0 AS white, ((c * 7) % 64)::INT AS shift FROM p1),
 p3 AS (SELECT *, ((shift + length(regexp_extract(concat(substr(board, shift + 1),
  left(board, shift)), CASE WHEN white THEN '^[^PNBRQK]*' ELSE '^[^pnbrqk]*' END))) % 64)::INT
  AS f FROM p2),
 p4 AS (SELECT *, ((f + 1 + c % 63) % 64)::INT AS t FROM p3),
 p5 AS (SELECT id, c, board, white, f, t, f // 8 AS fr, f % 8 AS ff, t // 8 AS tr, t % 8 AS tf,
  substr(board, f + 1, 1) AS piece, substr(board, t + 1, 1) AS target, 1 + c % 40 AS fullmove,
  id % 3 = 0 AS ep_here FROM p4),
 val(l, v) AS (VALUES ('p', 1), ('n', 3), ('b', 3), ('r', 5), ('q', 9), ('k', 0), ('.', 0)),
 p6 AS (SELECT p5.*, a.v AS pv, b.v AS cv, CASE WHEN white THEN fr - tr ELSE tr - fr END AS fwd,
  ep_here AND lower(piece) = 'p' AND abs(ff - tf) = 1 AND abs(fr - tr) = 1 AND target = '.' AS ep,
  lower(piece) = 'k' AND ff = 4 AND abs(tf - ff) = 2 AND fr = tr AND substr(board,
   (fr * 8 + CASE WHEN tf > ff THEN 7 ELSE 0 END)::INT + 1, 1) = CASE WHEN white THEN 'R'
   ELSE 'r' END AS castles,
  length(regexp_replace(board, '[^NBRQnbrq]', '', 'g')) AS heavy FROM p5
  JOIN val a ON a.l = lower(piece) JOIN val b ON b.l = lower(target)),
 sqs AS (SELECT i::INT AS i FROM range(64) r(i)),
 nb AS (SELECT id, string_agg(CASE WHEN castles AND i = fr * 8 + CASE WHEN tf > ff THEN 7 ELSE 0
  END THEN '.' WHEN castles AND i = fr * 8 + CASE WHEN tf > ff THEN 5 ELSE 3 END
  THEN CASE WHEN white THEN 'R' ELSE 'r' END WHEN i = t THEN piece WHEN i = f THEN '.'
  WHEN ep AND i = fr * 8 + tf THEN '.' ELSE substr(board, i + 1, 1) END, '' ORDER BY i) AS board
  FROM p6, sqs GROUP BY id),
 bds AS (SELECT id, 0 AS k, board FROM p6 UNION ALL SELECT id, 1, board FROM nb),
 men AS (SELECT id, k, i AS s, i // 8 AS r, i % 8 AS c, board, substr(board, i + 1, 1) AS m
  FROM bds, sqs WHERE substr(board, i + 1, 1) <> '.')"""


def _hits(targets: str) -> str:
    """Attackers of the (id, k, sq, tag) rows of a CTE."""
    return f"""pairs AS (SELECT t.id, t.k, t.sq, t.tag, m.m, m.board, m.s, t.sq // 8 - m.r AS dr,
  t.sq % 8 - m.c AS dc FROM {targets} t JOIN men m ON m.id = t.id AND m.k = t.k
  WHERE m.s <> t.sq),
 shaped AS (SELECT *, greatest(abs(dr), abs(dc)) AS n FROM pairs WHERE CASE lower(m)
  WHEN 'n' THEN abs(dr) * abs(dc) = 2 WHEN 'k' THEN greatest(abs(dr), abs(dc)) = 1
  WHEN 'p' THEN abs(dc) = 1 AND dr = CASE WHEN m = 'P' THEN -1 ELSE 1 END
  WHEN 'b' THEN abs(dr) = abs(dc) WHEN 'r' THEN dr * dc = 0
  ELSE abs(dr) = abs(dc) OR dr * dc = 0 END),
 hits AS (SELECT id, k, sq, tag, m, s FROM shaped WHERE n <= 1 OR lower(m) IN ('n', 'k', 'p') OR
  list_aggregate(list_transform(range(1, n::INT), lambda j: substr(board,
   (s + j * (sign(dr) * 8 + sign(dc)))::INT + 1, 1)), 'string_agg', '') = repeat('.', (n - 1)::INT))"""


def _cols(df, *names):
    return df.select("id", *names)


@query("board_expand", f"""
WITH {_POS} SELECT id, board, CASE WHEN white THEN 'w' ELSE 'b' END AS side, fullmove FROM p6""")
def board_expand(spark, sf):
    return _cols(bo.with_board(positions(spark, sf)), "board", "side", "fullmove")


def _parsed(spark, sf):
    return bo.playable(bo.with_move(bo.with_board(positions(spark, sf))))


@query("move_geometry", f"""
WITH {_POS} SELECT id, fwd > 0 AS advance, fwd < 0 AS retreat, fwd <= -2 AS deep_retreat,
 fwd >= 2 AS advance2plus, fwd = 0 AS sideways, greatest(abs(fr - tr), abs(ff - tf)) >= 3
 AS long_move, tf IN (0, 7) OR tr IN (0, 7) AS to_rim FROM p6""")
def move_geometry(spark, sf):
    return _cols(bo.move_geometry(_parsed(spark, sf)), "advance", "retreat", "deep_retreat",
                 "advance2plus", "sideways", "long_move", "to_rim")


@query("piece_facts", f"""
WITH {_POS} SELECT id, CASE lower(piece) WHEN 'p' THEN 'pawn' WHEN 'n' THEN 'knight' WHEN 'b'
 THEN 'bishop' WHEN 'r' THEN 'rook' WHEN 'q' THEN 'queen' ELSE 'king' END AS piece_name,
 lower(piece) IN ('n', 'b') AS piece_minor, target <> '.' AS is_capture,
 target <> '.' OR ep AS capture, target <> '.' AND cv < pv AS captures_smaller FROM p6""")
def piece_facts(spark, sf):
    return _cols(bo.piece_facts(_parsed(spark, sf)), "piece_name", "piece_minor", "is_capture",
                 "capture", "captures_smaller")


@query("phase", f"""
WITH {_POS} SELECT id, CASE WHEN heavy <= 6 THEN 'endgame' WHEN fullmove <= 12 THEN 'opening'
 ELSE 'middlegame' END AS phase, heavy <= 6 AS endgame, lower(piece) = 'k' AND heavy > 6
 AS king_walk FROM p6""")
def phase(spark, sf):
    return _cols(bo.phase(_parsed(spark, sf)), "phase", "endgame", "king_walk")


@query("material", f"""
WITH {_POS}, s AS (SELECT men.id, sum(CASE WHEN m = upper(m) THEN v ELSE 0 END)::BIGINT AS w,
  sum(CASE WHEN m = lower(m) THEN v ELSE 0 END)::BIGINT AS b FROM men JOIN val ON l = lower(m)
  WHERE k = 0 GROUP BY men.id)
SELECT p6.id, CASE WHEN white THEN w ELSE b END AS our_material,
 CASE WHEN white THEN b ELSE w END AS their_material,
 CASE WHEN white THEN w < b - 1 ELSE b < w - 1 END AS material_down FROM p6 JOIN s ON s.id = p6.id
""")
def material(spark, sf):
    return _cols(bo.material(_parsed(spark, sf)), "our_material", "their_material",
                 "material_down")


@query("attack_map", f"""
WITH {_POS}, tg AS (SELECT id, 0 AS k, f AS sq, 'f' AS tag FROM p6 UNION ALL
  SELECT id, 0, t, 't' FROM p6), {_hits("tg")},
 n AS (SELECT h.id, count(CASE WHEN tag = 'f' THEN 1 END) AS a, count(CASE WHEN tag = 't' THEN 1
  END) AS b, count(CASE WHEN tag = 't' AND lower(m) = 'p' THEN 1 END) AS pw FROM hits h
  JOIN p6 ON p6.id = h.id WHERE (m = upper(m)) <> white GROUP BY h.id)
SELECT p6.id, coalesce(a, 0) AS from_attackers, coalesce(b, 0) AS to_attackers,
 coalesce(pw, 0) AS to_pawn_attackers, coalesce(a, 0) > 0 AND coalesce(b, 0) = 0 AS escapes_attack,
 coalesce(a, 0) = 0 AND coalesce(b, 0) > 0 AS into_attack,
 coalesce(pw, 0) > 0 AND pv > 1 AS to_pawn_attacked FROM p6 LEFT JOIN n ON n.id = p6.id""")
def attack_map(spark, sf):
    df = bo.attack_map(bo.with_attacks(bo.piece_facts(_parsed(spark, sf))))
    return _cols(df, "from_attackers", "to_attackers", "to_pawn_attackers", "escapes_attack",
                 "into_attack", "to_pawn_attacked")


@query("after_move", f"""
WITH {_POS}, tg AS (SELECT id, 1 AS k, t AS sq, 'land' AS tag FROM p6 UNION ALL
  SELECT id, 1, s, 'man' FROM men WHERE k = 1), {_hits("tg")},
 w AS (SELECT h.*, white, pv, cv, t, (h.m = upper(h.m)) = white AS mine, v.v AS mv,
  substr(nb.board, h.sq::INT + 1, 1) AS on_sq FROM hits h JOIN p6 ON p6.id = h.id
  JOIN nb ON nb.id = h.id JOIN val v ON v.l = lower(h.m)),
 land AS (SELECT id, count(CASE WHEN NOT mine THEN 1 END) AS a, count(CASE WHEN mine THEN 1 END)
  AS d, coalesce(bool_or(NOT mine AND mv < greatest(pv, 1)), false) AS lesser FROM w
  WHERE tag = 'land' GROUP BY id),
 guard AS (SELECT id, sq, count(CASE WHEN NOT mine THEN 1 END) AS g FROM w WHERE tag = 'man'
  GROUP BY id, sq),
 threat AS (SELECT w.id, bool_or((on_sq = upper(on_sq)) <> white AND (tv.v > pv OR g = 0)) AS th
  FROM w JOIN guard ON guard.id = w.id AND guard.sq = w.sq JOIN val tv ON tv.l = lower(on_sq)
  WHERE tag = 'man' AND w.s = w.t AND mine GROUP BY w.id)
SELECT p6.id, coalesce(a, 0) > coalesce(d, 0) AS lands_en_prise, coalesce(lesser, false)
 AS att_by_lesser_after, (coalesce(a, 0) > coalesce(d, 0) OR coalesce(lesser, false)) AND cv < pv
 AS offers_material, coalesce(th, false) AS creates_threat
FROM p6 LEFT JOIN land ON land.id = p6.id LEFT JOIN threat ON threat.id = p6.id""")
def after_move(spark, sf):
    df = bo.after_move(bo.with_attacks(bo.piece_facts(_parsed(spark, sf))))
    return _cols(df, "lands_en_prise", "att_by_lesser_after", "offers_material",
                 "creates_threat")


@query("check_flags", f"""
WITH {_POS}, tg AS (SELECT men.id, men.k, s AS sq, 'k' AS tag FROM men JOIN p6 ON p6.id = men.id
  WHERE m = CASE WHEN white = (men.k = 0) THEN 'K' ELSE 'k' END), {_hits("tg")},
 c AS (SELECT h.id, count(CASE WHEN k = 0 AND (m = upper(m)) <> white THEN 1 END) > 0 AS a,
  count(CASE WHEN k = 1 AND (m = upper(m)) = white THEN 1 END) > 0 AS b FROM hits h
  JOIN p6 ON p6.id = h.id GROUP BY h.id)
SELECT p6.id, coalesce(a, false) AS in_check, coalesce(b, false) AS gives_check,
 target = '.' AND NOT coalesce(b, false) AS quiet FROM p6 LEFT JOIN c ON c.id = p6.id""")
def check_flags(spark, sf):
    df = bo.check_flags(bo.with_attacks(bo.piece_facts(_parsed(spark, sf))))
    return _cols(df, "in_check", "gives_check", "quiet")


@query("king_pressure", f"""
WITH {_POS}, own AS (SELECT men.id, men.k, s FROM men JOIN p6 ON p6.id = men.id
  WHERE m = CASE WHEN white THEN 'K' ELSE 'k' END),
 opp AS (SELECT men.id, s FROM men JOIN p6 ON p6.id = men.id
  WHERE men.k = 0 AND m = CASE WHEN white THEN 'k' ELSE 'K' END),
 tg AS (SELECT id, k, i AS sq, 'r' AS tag FROM own, sqs WHERE
  greatest(abs(i // 8 - s // 8), abs(i % 8 - s % 8)) = 1), {_hits("tg")},
 c AS (SELECT h.id, count(CASE WHEN k = 0 THEN 1 END) AS a, count(CASE WHEN k = 1 THEN 1 END) AS b
  FROM hits h JOIN p6 ON p6.id = h.id WHERE (m = upper(m)) <> white GROUP BY h.id)
SELECT p6.id, coalesce(a, 0) AS pressure_before, coalesce(b, 0) AS pressure_after,
 coalesce(b, 0) > coalesce(a, 0) AS weakens_own_king,
 greatest(abs(tr - o.s // 8), abs(tf - o.s % 8)) < greatest(abs(fr - o.s // 8), abs(ff - o.s % 8))
 AS toward_their_king
FROM p6 LEFT JOIN c ON c.id = p6.id LEFT JOIN opp o ON o.id = p6.id""")
def king_pressure(spark, sf):
    df = bo.king_pressure(bo.with_attacks(bo.piece_facts(_parsed(spark, sf))))
    return _cols(df, "pressure_before", "pressure_after", "weakens_own_king",
                 "toward_their_king")


@query("mobility", f"""
WITH {_POS}, n AS (SELECT id, c % 60 AS a, c % 9 AS b, c % 47 AS r FROM p6)
SELECT id, a >= 35 AS many_options, b >= 6 AS high_tension, r < a * 0.85 AS restricting FROM n""")
def mobility(spark, sf):
    counts = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 60).alias("n_legal"),
        (F.col("o_custkey") % 9).alias("n_captures"), (F.col("o_custkey") % 47).alias("n_replies"))
    return _cols(bo.mobility(counts), "many_options", "high_tension", "restricting")


@query("move_features")
def move_features(spark, sf):
    full = bo.move_features(positions(spark, sf))
    return full.groupBy("phase").agg(F.count("*").alias("n"), *[
        F.avg(F.col(c).cast("double")).alias(c) for c in bo.READABLE])
