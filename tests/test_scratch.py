from pathlib import Path

from quoin.scratch import bucketed, clear, drop, session_dir, stored


def test_stored_tables_go(spark):
    a, b = stored(spark.range(5), "a"), stored(spark.range(7), "b")
    folder = Path(session_dir(spark).removeprefix("file://"))
    assert (a.count(), b.count(), len(list(folder.glob("[ab]-*")))) == (5, 7, 2)
    drop(a)
    assert b.count() == 7 and not list(folder.glob("a-*"))
    clear(spark)
    assert not folder.exists() and stored(spark.range(3), "c").count() == 3


def test_buckets_meet_without_a_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 100 as k", "id as v", "cast(id % 2 as int) as part")
    table = bucketed(df.repartition(4, "k").sortWithinPartitions("part", "k"), "halves", 4, "k", "part")
    one, two = (table.filter(f"part = {p}").select("k", "v") for p in (0, 1))
    met = one.hint("merge").join(two, "k", "full")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 1000
    name = spark.sparkContext._quoin_tables[-1]
    assert spark.catalog.tableExists(name)
    clear(spark)
    assert not spark.catalog.tableExists(name)
