import __spark_entry__ as entry
import corpus_pipeline
from pagewarden.llm import langid, mixing, quality, simhash
from pagewarden.llm.queries import labelled_domains

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "mixing_to_targets", "sentencepiece"]


def test_pipeline_against_its_operators(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = langid.keep_identified(docs)
    two = quality.keep_good(one, labels)
    three = simhash.keep_one_of_each(two)
    four = mixing.mixed(three, labelled_domains(three, labels))
    want = sorted(r.doc_id for r in four.select("doc_id").collect())
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == want and len(set(want)) > 100
    assert all(len(r.ids) > 0 for r in out)


def test_the_query_runs(spark):
    assert entry.queries()["pipeline"](spark, SF).columns == ["doc_id", "ids"]
