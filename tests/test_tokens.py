import os
import shutil

import pytest

from whence.sources.jdbc import jdbc_options
from whence.sources.store import read_store, write_store
from whence.sources.tokens import annotate_keys, annotate_ordinal, file_number, read_annotated
from whence.operators.grouping import distinct, group
from whence.operators.semirings import expand
from whence.functions.aggregates import count


def tokens(frame):
    return [r["how"] for r in frame.how().collect()]


def test_ordinal_counts_copies_apart(spark, tmp_path):
    spark.createDataFrame([(1, "a")] * 5 + [(2, "b")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "t"))
    frame = annotate_ordinal(spark.read.parquet(str(tmp_path / "t")), "L")
    (file,) = [f for f in os.listdir(tmp_path / "t") if f.startswith("part-")]
    names = [f"L{file_number(file)}_{i}" for i in range(1, 7)]
    assert sorted(tokens(frame)) == sorted(names)
    # the number belongs to the row, not to the result of a filter
    assert tokens(frame.filter("k = 2")) == names[5:]


def test_ordinal_stays_when_the_table_is_moved_or_grows(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 3 as p")
    df.repartition(2).write.partitionBy("p").parquet(str(tmp_path / "a"))
    shutil.copytree(tmp_path / "a", tmp_path / "b" / "c")
    before, after = (
        {r["id"]: r["how"] for r in annotate_ordinal(spark.read.parquet(str(p)), "L").how().collect()}
        for p in (tmp_path / "a", tmp_path / "b" / "c")
    )
    assert before == after and len(set(before.values())) == 20
    spark.range(100, 105).selectExpr("id", "id % 3 as p").write.mode("append").partitionBy("p").parquet(str(tmp_path / "a"))
    grown = {r["id"]: r["how"] for r in annotate_ordinal(spark.read.parquet(str(tmp_path / "a")), "L").how().collect()}
    assert before.items() <= grown.items() and len(set(grown.values())) == 25


def test_compound_keys_do_not_collide(spark):
    rows = [("a_b", "c"), ("a", "b_c"), ("a", None), (None, "a"), ("a\\", "_"), ("a", "\\N")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert len(set(tokens(annotate_keys(df, "T", ["a", "b"])))) == len(rows)


def test_ordinal_of_many_files_is_unique_and_stable(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    first = sorted(r.asDict()["how"] + str(r["id"]) for r in annotate_ordinal(df, "L").how().collect())
    second = sorted(r["how"] + str(r["id"]) for r in annotate_ordinal(df, "L").filter("id >= 0").how().collect())
    assert len(set(tokens(annotate_ordinal(df, "L")))) == 1000
    assert first == second


def test_compound_and_qualified_keys(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tokens(annotate_keys(df, "PS", ["a", "b"])) == ["PS1_2"]
    assert tokens(annotate_keys(df, "PS", ["a", "b"], qualified="db:s:t")) == ["db:s:t:PS1_2"]


def test_annotated_table_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "C1"), (2, "C2")], "k int, prov string").write.parquet(path)
    frame = read_annotated(spark.read.parquet(path))
    assert sorted(tokens(frame)) == ["C1", "C2"]
    assert sorted(tokens(read_annotated(spark.read.parquet(path), qualified="s:c"))) == ["s:c:C1", "s:c:C2"]


def test_plain_run_drops_the_tokens(frame):
    f = frame("C", "k int, v int", [(1, 5)])
    assert f.plain().columns == ["k", "v"]
    assert "concat" not in f.plain()._jdf.queryExecution().optimizedPlan().toString()


def test_jdbc_options():
    o = jdbc_options("postgresql", "host:5432/db", "orders", "u", "p", ssl=True, schema="s", partition=("k", 0, 9, 4))
    assert o["url"] == "jdbc:postgresql://host:5432/db" and o["dbtable"] == "s.orders" and o["ssl"] == "true"
    assert o["partitionColumn"] == "k" and o["numPartitions"] == "4"
    assert jdbc_options("trino", "jdbc:trino://h/c", "t", "u", ssl=True, one_task=True)["SSL"] == "true"
    for args in (("oracle", "x", "t", "u"), ("trino", "x", "t", "u")):
        with pytest.raises(ValueError):
            jdbc_options(*args)


def test_store_round_trip(frame, spark, tmp_path):
    f = frame("C", "k int, g int", [(1, 1), (2, 1), (3, 2)])
    squared = f.join(f.prefixed("b_"), [("g", "b_g")]).select("g")
    poly = expand(distinct(squared, "D"))
    write_store(poly, str(tmp_path / "store"))
    back = read_store(spark, str(tmp_path / "store"))
    same = lambda p: sorted((r["out"], tuple(r["m"]), r["c"]) for r in p.terms.collect())
    assert same(back) == same(poly)
    assert ("D[1]", ("C1", "C2"), 2) in same(back) and ("D[1]", ("C1", "C1"), 1) in same(back)


def test_checkpoint_keeps_the_rows(frame):
    g = group(frame("C", "k int, g int", [(1, 1), (2, 1)]), ["g"], "G", {"n": count()})
    cut = g.checkpointed()
    assert cut.how().collect() == g.how().collect()
    assert sorted(map(tuple, cut.circuit().collect())) == [("G[1]", "C1", 1), ("G[1]", "C2", 1)]
    assert "LogicalRDD" in cut.df._jdf.queryExecution().analyzed().toString()
