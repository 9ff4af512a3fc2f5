"""The grader on held-out documents and on odd rows."""

from pyspark.sql import functions as F

from lumenstep.llm.ordinal import accepted, fit


def test_held_out_grades(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    model = fit(docs, known, min_z=5.0)
    rest = model.score(docs).join(labels.where("doc_id % 2 = 1"), "doc_id").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    got = {r.good: r for r in rest.groupBy("good").agg(F.avg((F.col("tail_probability") >= 0.5).cast("int")).alias("kept"), F.avg("expected_grade").alias("grade")).collect()}
    assert got[True].kept > 0.95 and got[False].kept < 0.35
    assert got[True].grade > got[False].grade + 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 1.0), (1, "", "x", 2.0), (None, "word " * 5000, "y", None), (4, "ok ok", None, 0.0)], "doc_id long, text string, lang string, grade double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert fit(docs, labels).score(docs).count() == 4
    two = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    out = fit(docs, two).score(docs)
    assert out.columns == [*docs.columns, "expected_grade", "tail_probability"]
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out.collect())
    assert accepted(docs.limit(0), two).columns == docs.columns


def test_accepted_keeps_the_users_columns(spark):
    from lumenstep.llm import ordinal

    docs = spark.createDataFrame([(i, ("vile rot " if i % 2 else "calm good ") * 5 + str(i), 7.5, "mine") for i in range(200)] + [(None, None, 7.5, "mine")], "doc_id long, text string, tail_probability double, _c0 string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(0, 160)], "doc_id long, quality int, toxic int")
    out = ordinal.accepted(docs, labels)
    rows = out.collect()
    assert out.columns == docs.columns and rows and all(r.tail_probability == 7.5 and r["_c0"] == "mine" for r in rows)
    assert {r.doc_id for r in rows if r.doc_id is not None} == set(range(0, 200, 2))
    assert ordinal.accepted(docs.limit(0), labels).count() == 0 and ordinal.accepted(docs, labels.limit(0)).columns == docs.columns
