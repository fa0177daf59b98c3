"""The study's tables expressed over the given star-schema and document tables.

Each table exists twice: as a DataFrame and as SQL text for the cross-check. Only exact
arithmetic is used, so both engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.operators.joins import attach_ratings
from crowdgap.operators.ordering import dedupe
from crowdgap.operators.rows import flag_disagreement, flag_hard_core
from crowdgap.streaming.jobs import read_files

LEVELS = ["p1", "p2", "p3", "p4"]

_GAMES = {
    "game_id": "o_orderkey",
    "white_elo": "1500 + (o_custkey * 37) % 1600",
    "black_elo": "1500 + (o_orderkey * 53) % 1600",
    "white_tag": "CASE WHEN o_custkey % 50 = 0 THEN '?' WHEN o_custkey % 50 = 1 THEN NULL "
                 "ELSE CAST(1500 + (o_custkey * 37) % 1600 AS STRING) END",
    "black_tag": "CAST(1500 + (o_orderkey * 53) % 1600 AS STRING)",
    "time_control": "CASE WHEN o_orderkey % 17 = 0 THEN '-' ELSE "
                    "concat(CAST((o_orderkey % 4) * 300 AS STRING), '+', "
                    "CAST(o_orderkey % 3 AS STRING)) END",
    "termination": "CASE o_orderstatus WHEN 'F' THEN 'Abandoned' WHEN 'P' THEN NULL "
                   "ELSE 'Normal' END",
    "seq": "o_orderkey",
}
_EVALS = {
    "item_key": "concat_ws('-', CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))",
    "game_id": "l_orderkey",
    "ply": "l_linenumber",
    "stm": "CASE WHEN l_linenumber % 2 = 1 THEN 'w' ELSE 'b' END",
    "best": "l_returnflag",
    "picked": "CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'A' END",
    "favourite": "CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END",
    "best_cp": "l_extendedprice / 100",
    "second_cp": "CASE WHEN l_quantity = 2 THEN NULL ELSE l_extendedprice / 100 - l_quantity * 3 "
                 "END",
    "favourite_cp": "CASE WHEN l_quantity = 1 THEN NULL ELSE l_extendedprice / 100 - "
                    "(l_extendedprice / 200 - 50) END",
    "cost": "CASE WHEN l_quantity = 1 THEN NULL ELSE l_extendedprice / 200 - 50 END",
    "p1": "l_tax * 1.25 + l_discount / 10",
    "p2": "l_tax * 2.5 + l_discount / 10",
    "p3": "l_tax * 3.75 + l_discount / 10",
    "p4": "l_tax * 5 + l_discount / 10",
    "batch": "year(l_shipdate)",
}
_ATTEMPTS = {
    "id": "event_id",
    "code": "user_id",
    "concept": "event_id % 8",
    "idx": "CAST(floor(event_id / 8) AS BIGINT) % 36",
    "correct": "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END",
    "human_p": "value / 499",
    "event_type": "event_type",
    "created_at": "ts",
}


def _sql(name: str, columns: dict[str, str], table: str) -> str:
    body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"{name} AS (SELECT {body} FROM {table})"


def _frame(spark: SparkSession, sf: str, table: str, columns: dict[str, str]) -> DataFrame:
    exprs = [f"{e} AS {c}" for c, e in columns.items()]
    return read(spark, sf, table).selectExpr(*exprs)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def games(spark, sf) -> DataFrame:
    return _frame(spark, sf, "orders", _GAMES)


def evals(spark, sf) -> DataFrame:
    return _frame(spark, sf, "lineitem", _EVALS)


def attempts(spark, sf) -> DataFrame:
    return _frame(spark, sf, "events", _ATTEMPTS)


def select_stream(spark, sf, table: str) -> DataFrame:
    """The bound table as a stream of its file."""
    schema = read(spark, sf, table).schema
    columns = {"orders": _GAMES, "lineitem": _EVALS, "events": _ATTEMPTS}[table]
    # a pattern, so that the table may be one file or a folder
    source = read_files(spark, f"{sf}/{table}.parquet*", schema)
    return source.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def arrival() -> list:
    """Total order of the rows of one key: arrival first, then every payload column."""
    return ["batch", "game_id", "ply", "best_cp", F.col("second_cp").asc_nulls_first(),
            F.col("cost").asc_nulls_first(), "p1", "p4", "best", "picked"]


def master(spark, sf) -> DataFrame:
    """Consolidated items: keep-first dedupe, ratings, flags (one shuffle per key)."""
    items = dedupe(evals(spark, sf), "item_key", arrival())
    rated = attach_ratings(items, games(spark, sf).select("game_id", "white_elo", "black_elo"),
                           "game_id")
    flagged = flag_disagreement(rated, LEVELS)
    return (flag_hard_core(flagged)
            .withColumn("p_max", F.round(m.p_max(LEVELS), 4))
            .withColumn("mover_rating", m.mover_rating("stm", "white_elo", "black_elo")))


GAMES = _sql("games", _GAMES, "orders")
EVALS = _sql("evals", _EVALS, "lineitem")
ATTEMPTS = _sql("attempts", _ATTEMPTS, "events")
_DEDUPED = """deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY item_key ORDER BY batch, game_id, ply, best_cp, second_cp NULLS FIRST,
  cost NULLS FIRST, p1, p4, best, picked) AS rn FROM evals) WHERE rn = 1)"""
MASTER = f"""{GAMES}, {EVALS}, {_DEDUPED},
master AS (SELECT f.*, picked = best AS found, flagged AND picked <> best AS hard_core,
  CASE stm WHEN 'w' THEN white_elo WHEN 'b' THEN black_elo END AS mover_rating
 FROM (SELECT d.*, g.white_elo, g.black_elo,
   coalesce(d.cost >= 100 AND greatest(p1, p2, p3, p4) <= 0.05::DOUBLE, false) AS flagged,
   round(greatest(p1, p2, p3, p4), 4) AS p_max
   FROM deduped d LEFT JOIN games g ON d.game_id = g.game_id) f)"""
BANDS_SQL = """bands(band_order, band, lo, hi) AS (VALUES (0,'<2000',0,2000),
 (1,'2000-2200',2000,2200), (2,'2200-2400',2200,2400), (3,'2400-2600',2400,2600),
 (4,'2600-2800',2600,2800), (5,'2800+',2800,4000))"""
