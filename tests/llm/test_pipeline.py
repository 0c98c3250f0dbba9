"""The pipeline: columns, decisions of each stage, and the whole against its parts."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as pipeline
from bibloom.llm.common import materialize, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, n = docs.columns, docs.count()
    odd = spark.createDataFrame([(90_001, "123 ...", "en", "s", 7), (90_002, None, "en", "s", 0), (90_003, docs.first()["text"], "en", "s", 0)], docs.schema)
    now = docs.unionByName(odd)
    for name, stage in pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, FOLDER), name)
        assert now.columns == columns and now.count() <= n + 3
        ids = {r[0] for r in now.select("doc_id").collect()}
        assert not ids & {90_001, 90_002}
    assert 90_003 not in ids
    assert now.where(F.length("text") != F.col("n_chars")).count() == 0
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pipeline.STAGES[-1][1](spark, now, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    for r in rows:
        assert r["ids"] == library.encode(kept[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_and_registration(spark):
    assert 0 < pipeline.run(spark, FOLDER).count() <= 200
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_on_odd_tables(spark):
    """Null ids and texts, an id on two texts, repeated rows, further columns, and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, version string, line string"
    one, two = "words of a text that nobody else has written down", "quite another text that stands under the same id"
    rows = [(1, one, "en", "s", len(one), "v", "l"), (1, two, "en", None, len(two), "v", "l"), (1, one, "en", "s", len(one), "v", "l"), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "v", "l"), (None, one + " again", "en", "s", 54, "v", "l")]
    for data in (rows, []):
        now = spark.createDataFrame(data, schema)
        for name, stage in pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, FOLDER), name)
            assert now.columns == [c.split(" ")[0] for c in schema.split(", ")]
        texts = sorted(r["text"] for r in now.collect())
        assert texts == (sorted([one, two, one + " again"]) if data else [])
        assert pipeline.STAGES[-1][1](spark, now, FOLDER).count() == len(texts)


def test_columns_of_any_names(spark):
    """A caller's columns keep their values, though the stages use their names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_lines int, n_removed int, _key int, _id int, _version int, _gone int, _doc int, component_id int, fp int, version int, own_score int"
    one = "words of a text that nobody else has written down\nand a line that stands twice, here and below\nand a line that stands twice, here and below"
    rows = [(k, f"{one} {'x' * k}", "en", "s", 9, 7.5, "p", 9, 8, 7, 6, 5, 4, 3, 2, 1, 0, -1) for k in (1, 2, 40)]
    now = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, FOLDER), name)
        assert now.columns == [c.split(" ")[0] for c in schema.split(", ")]
    assert now.count() >= 1
    for r in now.collect():
        assert tuple(r)[5:] == rows[0][5:]
