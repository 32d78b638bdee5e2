"""Queries do the whole job: every take, every line."""

import duckdb


def test_words_json_writes_every_take(spark, tmp_path):
    import __spark_entry__ as E

    data = [("m", 0, 0, 0, 0.1, 0.2, "a", 1), ("m", 0, 0, 0, 0.1, 0.2, "a", 2), ("m", 1, 0, 0, 1.0, 1.5, "b", 1), ("m", 1, 1, 0, 2.0, None, None, 1), ("n", 2, 0, 0, 3.0, 3.5, "c", 1)]
    schema = "media_id string, take_no int, idx int, seg_idx int, start double, end double, text string, loaded_at int"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "words.parquet"))
    got = sorted(tuple(r) for r in E.queries()["q_words_json"](spark, str(tmp_path)).select("media_id", "words", "texts", "starts").collect())
    assert got == [("m#0", 1, 1, 100), ("m#1", 2, 1, 3000), ("n#2", 1, 1, 3000)]
    want = f"""with d as (select media_id, take_no, idx, min(struct_pack(l := loaded_at, s := "start", t := text)) as r from read_parquet('{tmp_path}/words.parquet/*.parquet') group by all)
select media_id || '#' || take_no, count(*), count(r.t), cast(sum(cast(round(r.s * 1000) as bigint)) as bigint) from d group by media_id, take_no"""
    assert got == sorted(duckdb.connect().execute(want).fetchall())


def test_replay_asks_for_every_line(spark, tmp_path):
    import __spark_entry__ as E

    data = [(m, take, i, float(i), i + 0.9, f"{m} {take} says {i}", 0.0, 1) for m, take, n in (("m", 0, 9), ("m", 1, 5), ("n", 0, 1)) for i in range(n)]
    schema = "media_id string, take_no int, seg_no int, start double, end double, text string, no_speech_prob double, loaded_at int"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "segments.parquet"))
    got = {r.state: r.n for r in E.queries()["q_replay"](spark, str(tmp_path)).collect()}
    assert got == {"translated": 5, "kept_source": 10}  # each take's first window of two lines is known
