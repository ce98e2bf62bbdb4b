"""Each stage on its own input against a plain version, and the whole run."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import brute


def keep(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "secrets", "packing"]

    one = keep(spark, stages["language"](spark, docs, sf_dir), tmp_path, 1)
    assert one.columns == docs.columns and one.count() >= 0.98 * docs.count()

    two = keep(spark, stages["near_duplicates"](spark, one, sf_dir), tmp_path, 2)
    want = {c for _, c in brute.linked_components([(r.doc_id, r.text) for r in one.collect()]).values()}
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(want)

    three = keep(spark, stages["decontamination"](spark, two, sf_dir), tmp_path, 3)
    found = brute.contamination([(r.doc_id, r.text) for r in two.collect()], items)
    assert {r.doc_id: r.text for r in three.collect()} == {r.doc_id: r.text for r in two.collect() if not (found[r.doc_id][1] and 20 * found[r.doc_id][1] >= found[r.doc_id][0])}

    four = keep(spark, stages["secrets"](spark, three, sf_dir), tmp_path, 4)
    before = {r.doc_id: r.text for r in three.collect()}
    assert four.columns == docs.columns and four.count() == len(before)
    for r in four.collect():
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text) and (r.text == before[r.doc_id] or "[secret]" in r.text)

    five = stages["packing"](spark, four, sf_dir).collect()
    assert {r.doc_id for r in five} == set(before)


def test_odd_rows_pass_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "the and of this thing", None, None, None), (-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "the and of the thand", "en", "s", 1), (-3, "the and of the thand", "en", "s", 1)], docs.schema)
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs.unionByName(odd), sf_dir)
        assert got.columns == docs.columns and got.where("doc_id IS NULL").count() == 1, name
        assert stage(spark, empty, sf_dir).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0


def test_rows_are_judged_by_their_own_text(spark, sf_dir):
    """A contaminated row without an id goes, and of several texts of an id the choice is the same every time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    odd = [(None, f"some words {item}", "en", "s", 1), (None, "plain words of no item at all", "en", "s", 2), (-9, f"{item} again", "en", "s", 3), (-9, "other words of the same identifier", "en", "s", 4)]
    stages = dict(pipeline.STAGES)
    clean = stages["decontamination"](spark, spark.createDataFrame(odd, docs.schema), sf_dir).collect()
    assert sorted(r.n_chars for r in clean) == [2, 4]
    many = [(7, f"text number {i} of one and the same document", "en", "s", i) for i in range(40)]
    first = {tuple(stages["near_duplicates"](spark, spark.createDataFrame(many, docs.schema).repartition(n), sf_dir).collect()[0]) for n in (1, 3, 7)}
    assert len(first) == 1


def test_columns_of_other_names_pass_through(spark, sf_dir):
    """Columns named like those that the stages make, and a text longer than any buffer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = spark.createDataFrame([(10**6, "the thing and the other thing of it " * 20_000, "en", "s", 0)], docs.schema)
    names = ("p", "spans", "rejected", "component_id", "class", "kept", "label")
    docs = docs.unionByName(long).withColumns({c: F.lit(c) for c in names})
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        rows = got.where("doc_id = 1000000").collect()
        assert len(rows) == 1 and [rows[0][c] for c in names] == [*names], name
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).where("doc_id = 1000000").count() > 20


def test_whole_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 < r.length <= 4096 for r in rows)
