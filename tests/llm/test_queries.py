import pytest

DATA = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": ["media_id", "take_no", "first_idx", "last_idx"],
    "p2_found": ["media_id", "take_no", "seg_no"],
    "p4_found": ["media_id", "take_no", "seg_no"],
    "p5_found": ["media_id", "take_no", "seg_no", "defect"],
    "p6_found": ["cue_a", "cue_b"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, DATA)
    assert df.columns == FOUND[name]
    got = df.collect()
    assert got and len(got) == len(set(got))
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_other_query_runs(spark):
    import __spark_entry__ as E

    for name, q in E.queries().items():
        if name[0] == "p" and name not in FOUND:
            assert q(spark, DATA).count() > 0, name


def test_oversized_by_sql(spark):
    import duckdb
    import __spark_entry__ as E

    con = duckdb.connect()
    con.execute(f"create view segments as select * from read_parquet('{DATA}/segments.parquet')")
    want = sorted(con.execute(E.oracle_sql()["p4_found"]).fetchall())
    assert sorted(tuple(r) for r in E.queries()["p4_found"](spark, DATA).collect()) == want


def test_pieces_of_every_oversized_segment_fit(spark):
    import __spark_entry__ as E

    p = E.queries()["p4_pieces"](spark, DATA)
    assert p.select("media_id", "take_no", "seg_no").distinct().count() == E.queries()["p4_found"](spark, DATA).count()
    assert p.where("not within").where("length(text) > 120 or size(split(text, ' ')) > 30").count() == 0
