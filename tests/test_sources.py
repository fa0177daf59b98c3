import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdgap.operators import rows
from crowdgap.operators.joins import Quota
from crowdgap.operators.ordering import dedupe
from crowdgap.sources import archives, sinks
from crowdgap.sources.live import LiveTable
from crowdgap.streaming import jobs

RECORDS = "\n\n".join([
    '[Event "a"]\n[Site "https://x/abc"]\n[WhiteElo "2100"]\n[BlackElo "1900"]\n'
    '[TimeControl "600+5"]\n[Termination "Normal"]\n\n1. e4 e5',
    '[Event "b"]\n[Site ""]\n[WhiteElo "2100"]\n[BlackElo "1900"]\n[TimeControl "-"]\n\n1. d4',
    '[Event "c"]\n[WhiteElo "?"]\n[BlackElo "1900"]\n[TimeControl "900+0"]\n\n1. c4',
    '[Event "d"]\n[WhiteElo "2000"]\n[BlackElo "2500"]\n[TimeControl "900+0"]\n'
    '[Termination "Abandoned"]\n\n1. c4',
    '[Event "e"]\n[WhiteElo "2000"]\n[BlackElo "2500"]\n[TimeControl "900+0"]\n\n1. f4'])


@pytest.mark.parametrize("packed", [False, True])
def test_archive_records(spark, tmp_path, packed):
    path = str(tmp_path / "games.pgn")
    if packed:
        import zstandard
        path += ".zst"
        with open(path, "wb") as fh:
            fh.write(zstandard.ZstdCompressor().compress(RECORDS.encode()))
    else:
        with open(path, "w") as fh:
            fh.write(RECORDS)
    recs = archives.read_records(spark, path)
    got = [r.record for r in recs.collect()]
    assert len(got) == 5 and all(r.startswith("[Event ") for r in got)
    assert got[-1].endswith("1. f4")
    tagged = archives.with_tags(recs, ["Event", "Site", "WhiteElo", "BlackElo", "TimeControl",
                                       "Termination"])
    kept = rows.eligible_games(tagged, 1800, 600, "WhiteElo", "BlackElo", "TimeControl",
                               "Termination")
    assert sorted(r.Event for r in kept.collect()) == ["a", "e"]
    elite = rows.eligible_games(tagged, None, white="WhiteElo", black="BlackElo")
    assert sorted(r.Event for r in elite.collect()) == ["a", "b", "d", "e"]


def test_missing_termination_column_value_passes(spark):
    df = spark.createDataFrame([("2000", "2000", "600+0", None), (None, "2000", "600+0", None),
                                ("2000", "2000", "599+0", "Normal")],
                               "white_elo string, black_elo string, time_control string, "
                               "termination string")
    assert rows.eligible_games(df).count() == 1


def test_batches_carry_their_file_name(spark, tmp_path):
    for name, n in (("03_elite_top", 3), ("03_disagreements", 2)):
        with open(tmp_path / f"{name}.csv", "w") as fh:
            fh.write("fen,cost\n" + "".join(f"{name}{i},\n" if i else f"{name}{i},1.5\n"
                                            for i in range(n)))
    schema = T.StructType([T.StructField("fen", T.StringType()), T.StructField("cost", T.DoubleType())])
    df = archives.read_batches(spark, str(tmp_path / "03_*.csv"), schema)
    got = {(r.batch, r.source, r.n, r.c) for r in df.groupBy("batch", "source").agg(
        F.count("*").alias("n"), F.count("cost").alias("c")).collect()}
    assert got == {("03_elite_top", "elite", 3, 1), ("03_disagreements", "club", 2, 1)}
    first = dedupe(df.withColumn("k", F.lit(1)), "k", ["batch", "fen"]).first()
    assert first.batch == "03_disagreements"


def test_position_slice_follows_the_file(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    with open(path, "w") as fh:
        fh.write("game_id,ply,fen,played_move,white_elo,black_elo\n")
        fh.writelines(f"g{i},14,f{i},e2e4,2000,\n" for i in range(10))
    got = archives.read_positions(spark, path, 3, 4).collect()
    assert [r.game_id for r in got] == ["g3", "g4", "g5", "g6"] and got[0].black_elo is None


def test_slices_follow_the_files(spark, tmp_path):
    """The second file is larger, so Spark reads it first; small splits cut it up."""
    head = "game_id,ply,fen,played_move,white_elo,black_elo\n"
    for name, n in (("a", 3), ("b", 3000), ("c", 5)):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"{name}{i},14,f,e2e4,2000,1\n" for i in range(n)))
    want = [f"{f}{i}" for f, n in (("a", 3), ("b", 3000), ("c", 5)) for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for offset, limit in ((0, 4), (1, 3), (2, 2000), (2990, None), (3000, 100)):
            got = archives.read_positions(spark, str(tmp_path / "*.csv"), offset, limit)
            assert sorted(r.game_id for r in got.collect()) == sorted(want[offset:][:limit])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tagged_lines_of_several_files(spark, tmp_path):
    head = "id,fen,moves,r,d,p,n,themes,url\n"
    (tmp_path / "1.csv").write_text(head + "a,f,m,1,2,3,4,fork,u\n")
    (tmp_path / "2.csv").write_text(head + "".join(f"b{i},f,m,1,2,3,4,pin,u\n" for i in range(50)) + head)
    got = archives.read_tagged(spark, str(tmp_path)).orderBy("arrival").collect()
    assert [r.id for r in got] == ["a", *[f"b{i}" for i in range(50)], "id"]


def test_tagged_lines(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as fh:
        fh.write("id,fen,moves,r,d,p,n,themes,url\na,f,m,1,2,3,4,fork pin,u\nshort,line\n"
                 "b,f,m,1,2,3,4,pin,u\n")
    got = {r.id: r.tags for r in archives.read_tagged(spark, path).collect()}
    assert got == {"a": ["fork", "pin"], "b": ["pin"]}


def test_nested_documents(spark, tmp_path):
    doc = [{"id": 1, "label": "Concept 2", "signature": {"positions": "4"},
            "study": [{"fen": "f1", "best": "e2e4", "human": [{"uci": "d2d4", "p": 0.5}]}],
            "drill": [{"fen": "f2", "p_best": 0.01}, {"fen": "f3"}]}]
    path = str(tmp_path / "concepts.json")
    with open(path, "w") as fh:
        json.dump(doc, fh)
    items = sinks.course_items(sinks.read_concepts(spark, path, multi_line=True))
    got = [(r.slot, r.idx, r.fen) for r in items.orderBy("slot", "idx").collect()]
    assert got == [("drill", 0, "f2"), ("drill", 1, "f3"), ("study", 0, "f1")]


def test_append_skips_known_keys(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.append_new(spark.range(5), path, "id")
    sinks.append_new(spark.range(3, 8), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))


def _files(spark, df, path, parts):
    for i in range(parts):
        df.where(F.col("seq") % parts == i if parts > 3 else F.col("part") == i).coalesce(1) \
            .write.mode("append").parquet(path)


def test_progress_stream_equals_batch(spark, tmp_path):
    src = spark.range(900).select(
        (F.col("id") % 7).alias("code"), (F.col("id") % 3).alias("concept"),
        (F.col("id") * 13 % 11).alias("idx"), (F.col("id") % 2).cast("int").alias("correct"),
        (F.col("id") / 300).cast("int").alias("part"), F.col("id").alias("seq"))
    path, sink = str(tmp_path / "in"), str(tmp_path / "out")
    _files(spark, src, path, 3)
    ckpt = str(tmp_path / "ck")
    feed = jobs.read_files(spark, path, src.schema, files_per_batch=1)
    jobs.progress_stream(feed, sink, ckpt).awaitTermination()
    assert spark.read.parquet(sink).select("version").distinct().count() == 3
    live = jobs.live_progress(jobs.item_counters(spark, sink))
    want = src.groupBy("code", "concept").agg(
        F.countDistinct("idx").alias("n"), F.sum(F.col("correct").cast("bigint")).alias("correct"),
        F.count("*").alias("tries"))
    assert live.exceptAll(want).count() == 0 and want.exceptAll(live).count() == 0
    # a later file continues from the checkpoint
    src.where("seq < 10").coalesce(1).write.mode("append").parquet(path)
    jobs.progress_stream(jobs.read_files(spark, path, src.schema, files_per_batch=1), sink,
                         ckpt).awaitTermination()
    assert jobs.live_totals(jobs.item_counters(spark, sink)).first().attempts == 910


def test_mining_stream_resumes_without_repeats(spark, tmp_path):
    src = spark.range(300).select((F.col("id") % 100).cast("string").alias("fen"),
                                  F.col("id").alias("seq"),
                                  (F.col("id") / 100).cast("int").alias("part"))
    path, sink = str(tmp_path / "in"), str(tmp_path / "out")
    _files(spark, src, path, 3)
    for ck in ("a", "b"):   # the second run starts from nothing and must add nothing
        jobs.mine_stream(jobs.read_files(spark, path, src.schema, files_per_batch=1), sink, "fen",
                         ["seq"], lambda b: b.withColumn("x", F.lit(1)),
                         str(tmp_path / ck)).awaitTermination()
        got = spark.read.parquet(sink)
        assert got.count() == 100 and got.agg(F.max("seq")).first()[0] == 99


def test_quota_stream_fills_in_arrival_order(spark, tmp_path):
    src = spark.range(3000).select(F.col("id").alias("k"), F.col("id").alias("seq"),
                                   F.when(F.col("id") % 5 == 0, "rare").otherwise("common").alias("band"),
                                   (F.col("id") / 1000).cast("int").alias("part"))
    path = str(tmp_path / "in")
    _files(spark, src, path, 3)
    sink = jobs.QuotaSink(spark, str(tmp_path / "out"),
                          [Quota("rare", 0, 0, 250), Quota("common", 0, 0, 90)], "k", "seq")
    jobs.quota_stream(jobs.read_files(spark, path, src.schema, files_per_batch=1), sink)
    got = spark.read.parquet(sink.path).toPandas()
    assert sink.full and sorted(got[got.band == "rare"].seq) == list(range(0, 1250, 5))
    assert sorted(got[got.band == "common"].seq) == [i for i in range(200) if i % 5][:90]


def test_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "s")
    for at, v in ((1.0, "a"), (3.0, "c"), (2.0, "b")):
        sinks.upsert(spark.createDataFrame([("u", 1, at, v)], "code string, concept int, at double, v string"), path)
    packed = sinks.compact(spark, path, ["code", "concept"], "at", str(tmp_path / "packed"))
    assert spark.read.parquet(packed).first().v == "c"


def test_a_map_with_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    sinks.rewrite_with_map(spark, path, spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string"), "k", "v")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "b")]
    with pytest.raises(Exception, match="several values"):
        sinks.rewrite_with_map(spark, path, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), "k", "v")


def test_rewrite_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "?"), ("b", "x")], "fen string, gid string").write.parquet(path)
    sinks.rewrite_with_map(spark, path, spark.createDataFrame([("a", "e1")], "fen string, gid string"),
                           "fen", "gid")
    assert {r.fen: r.gid for r in spark.read.parquet(path).collect()} == {"a": "e1", "b": "x"}
    assert not os.path.exists(path + ".__old") and not os.path.exists(path + ".__new")


def test_live_tables_read_touched_slots_and_swap_whole(spark, tmp_path):
    table = LiveTable(spark, str(tmp_path / "live"), "k", slots=8)
    assert table.read() is None and table.manifest() == {}
    rows = spark.range(40).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table.append_new(rows)
    table.append_new(rows)                                    # a replayed batch adds nothing
    assert table.read().count() == 40 and len(table.versions()) == 1
    one = spark.range(100, 101).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    slot = one.select(table._slot()).first()[0]
    # damage every other slot: an append that touches one slot does not read them
    other = [p for p in table.folders(table.manifest()) if not p.endswith(f"slot={slot}")]
    kept = {}
    for folder in other:
        for f in os.listdir(folder):
            if f.endswith(".parquet"):
                kept[f"{folder}/{f}"] = open(f"{folder}/{f}", "rb").read()
                open(f"{folder}/{f}", "wb").write(b"not a table")
                crc = f"{folder}/.{f}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    table.append_new(one)
    for f, data in kept.items():
        open(f, "wb").write(data)
    assert table.read().count() == 41 and len(table.versions()) == 2
    before = table.read()
    table.rewrite_with_map(spark.createDataFrame([(3, "new"), (3, "new")], "k long, v string"), "k", "v")
    assert {r.k: r.v for r in table.read().collect()}[3] == "new" and table.read().count() == 41
    assert before.where("v = 'new'").count() == 0 and before.count() == 41     # a running reader
    assert table.read(version=2).where("v = 'new'").count() == 0
    with pytest.raises(Exception, match="several values"):
        table.rewrite_with_map(spark.createDataFrame([(4, "x"), (4, "y")], "k long, v string"), "k", "v")
    assert table.read().count() == 41 and len(table.versions()) == 3
    table.replace(table.read().where("k < 0"))
    assert table.read() is None


def test_live_table_with_two_keys_and_null_keys(spark, tmp_path):
    table = LiveTable(spark, str(tmp_path / "live"), ["a", "b"])
    rows = spark.createDataFrame([("x", 1), ("x", 2), (None, 1)], "a string, b int")
    table.append_new(rows)
    table.append_new(rows.where("a is not null"))
    assert table.read().count() == 3


def test_rows_that_go_into_a_live_table_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    table = LiveTable(spark, str(tmp_path / "live"), "k")
    table.append_new(spark.range(50).select(counted("id").alias("k")))
    assert seen.value == 50 and table.read().count() == 50
    more = spark.range(40, 70)
    table.append_new(more.select(counted("id").alias("k")), more.withColumnRenamed("id", "k"))
    assert seen.value == 80 and sorted(r.k for r in table.read().collect()) == list(range(70))


def test_a_mining_batch_is_not_kept(spark, tmp_path, monkeypatch):
    path, sink = str(tmp_path / "in"), str(tmp_path / "out")
    src = spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("seq"),
                                 (F.col("id") / 20).cast("int").alias("part"))
    _files(spark, src, path, 3)
    monkeypatch.setattr(type(src), "persist", lambda *_: pytest.fail("a batch is kept"))
    jobs.mine_stream(jobs.read_files(spark, path, src.schema, files_per_batch=1), sink, "k", ["seq"],
                     lambda b: b).awaitTermination()
    assert sorted(map(tuple, LiveTable(spark, sink, "k").read().select("k", "seq").collect())) == [
        (i, i) for i in range(20)]
