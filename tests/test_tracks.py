"""Caption tracks, one to a file and packed."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuewright.plans import queries
from cuewright.sources import tracks

CUES = "video_id string, language string, kind string, idx int, start_s double, end_s double, text string"


def _files(folder):
    return [p for p in Path(folder).rglob("*") if p.is_file() and p.name[0] not in "._"]


def _cues(spark, videos):
    rows = [(f"v/{i} ü", ("en", "de", "pt-BR")[i % 3], ("manual", "generated")[i % 2], j, 2.5 * j, 2.5 * j + 1.25, text) for i in range(videos) for j, text in enumerate(["One\ntwo", None, "a\r\n\r\n\r\nb", "00:00:01.000 --> 00:00:02.000", "日本 😀"])]
    return spark.createDataFrame(rows, CUES).repartition(4)


def test_packed_tracks_hold_what_files_hold(spark, tmp_path):
    cues = _cues(spark, 60)
    tracks.write_tracks(cues, f"{tmp_path}/apart")
    tracks.write_tracks(cues, f"{tmp_path}/packed", packed=True)
    apart, packed = tracks.read_tracks(spark, f"{tmp_path}/apart"), tracks.read_tracks(spark, f"{tmp_path}/packed", packed=True)
    assert sorted(map(repr, packed.withColumn("text", F.trim("text", F.lit("\n"))).collect())) == sorted(map(repr, apart.withColumn("text", F.trim("text", F.lit("\n"))).collect()))
    assert packed.count() == 300 and len(_files(tmp_path / "apart")) == 60
    plan = packed.filter("language = 'de' AND video_id = 'v/1 ü'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan and "PushedFilters: [IsNotNull(video_id), EqualTo(video_id,v/1 ü)]" in plan
    tracks.write_tracks(_cues(spark, 6).withColumn("video_id", F.concat("video_id", F.lit("+"))), f"{tmp_path}/packed", packed=True)
    assert tracks.read_tracks(spark, f"{tmp_path}/packed", packed=True).count() == 330
    with pytest.raises(ValueError):
        tracks.read_tracks(spark, f"{tmp_path}/packed", flat=True, packed=True)


def test_packed_tracks_as_a_stream(spark, tmp_path):
    tracks.write_tracks(_cues(spark, 6), f"{tmp_path}/packed", packed=True)
    got = tracks.read_tracks(spark, f"{tmp_path}/packed", stream=True, packed=True)
    query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(tracks.read_tracks(spark, f"{tmp_path}/packed", packed=True))


def test_files_of_the_query_do_not_grow_with_its_tracks(spark, tmp_path, monkeypatch):
    """20 tracks of two languages; a shuffle of 4 partitions writes at most two files each."""
    monkeypatch.setattr(queries, "scratch_folder", lambda spark: f"file://{tmp_path}")
    got = queries.QUERIES["caption_tracks"](spark, "/root/testdata/sf0.001")
    assert got.select("video_id").distinct().count() == 13
    assert 0 < len(_files(tmp_path)) <= 8


def test_a_long_track_is_read_at_once(spark, tmp_path):
    """Numbers are not looked for in whole blocks, each anew."""
    blocks = [f"{i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}.000 --> {i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}.500\n{'word ' * 200}{i}" for i in range(12000)]
    (tmp_path / "v.en.vtt").write_text("WEBVTT\n\n" + "\n\n".join(blocks) + "\n")
    read = tracks.read_tracks(spark, str(tmp_path), flat=True)
    read.limit(1).collect()
    began = time.perf_counter()
    read.write.parquet(f"{tmp_path}/out")
    assert time.perf_counter() - began < 8
    rows = sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.idx)
    assert [(r.start_s, r.duration_s) for r in rows] == [(float(i), 0.5) for i in range(12000)]
    assert [r.text.strip() for r in rows] == [f"{'word ' * 200}{i}" for i in range(12000)]


@pytest.mark.parametrize("packed", [False, True])
def test_text_after_an_empty_line_stays(spark, tmp_path, packed):
    texts = ["\nfirst", " \r\n\n second\n\n", "\n\n", "third", "\t\n00:00:09.000 --> 00:00:10.000\n\nWEBVTT"]
    cues = spark.createDataFrame([("v", "en", "manual", i, 1.0 * i, 1.0 * i + 1, t) for i, t in enumerate(texts)], CUES)
    tracks.write_tracks(cues, f"{tmp_path}/t", packed=packed)
    got = tracks.read_tracks(spark, f"{tmp_path}/t", packed=packed).orderBy("idx").collect()
    assert [(r.idx, r.start_s, r.text.strip()) for r in got] == [(0, 0.0, "first"), (1, 1.0, "second"), (2, 2.0, ""), (3, 3.0, "third"), (4, 4.0, "00:00:09.000 --> 00:00:10.000\nWEBVTT")]


def test_the_query_as_its_sql_on_odd_rows(spark, tmp_path):
    import duckdb
    from compare import rows

    from cuewright.plans.oracles import ORACLES

    odd = [(1, 0, "\nfirst"), (1, 1, " \r\n\n second\n\nthird"), (1, 2, None), (1, 3, ""), (1, 4, "\n \n"), (1, 5, "x"), (None, 0, "nobody"), (2, 0, "00:00:01.000 --> 00:00:02.000"), (2, 1, "\t\n00:00:01.000 --> 00:00:02.000\n\nWEBVTT"), (3, 0, "de"), (-1, 0, "a\rb"), (-3, 0, "de")]
    spark.createDataFrame(odd, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLES["caption_tracks"])
    got = queries.QUERIES["caption_tracks"](spark, str(tmp_path))
    assert rows(got.columns, map(tuple, got.collect())) == rows([c[0] for c in want.description], want.fetchall())
