"""The pipeline against its parts, its stages on odd rows."""

import corpus_pipeline
import pytest
from test_duplicates import line_brute, near_brute
from test_tokens import check_pieces


def test_stages(spark, sf_dir, documents, library, union_find, tmp_path):
    """Each stage's decisions, checked against brute force on what its predecessor kept; then run() gives the last one's rows."""
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == documents.columns
        seen[name], docs = (docs, out), out
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, clean in (("toxicity", lambda y: y.toxic == 0), ("quality_classifier", lambda y: y.quality == 1)):
        before, after = ({r.doc_id for r in df.collect()} for df in seen[name])
        good = {i for i in before if i in labels and clean(labels[i])}
        assert after < before and len(good - after) <= 0.03 * len(good)
    before = [(r.doc_id, r.text) for r in seen["line_dedup"][0].collect()]
    gone = line_brute(before, union_find)
    want = {i: "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone[i]) for i, t in before}
    lines = {r.doc_id: r for r in seen["line_dedup"][1].collect()}
    assert {i: r.text for i, r in lines.items()} == want and all(r.n_chars == len(r.text) for i, r in lines.items() if gone[i])
    union_find.clear()
    kept = {r.doc_id for r in seen["near_dedup"][1].collect()}
    assert kept == {i for i, _, _, stays in near_brute([*want.items()], union_find) if stays}
    pieces = seen["packing"][1].collect()
    check_pieces(pieces, [(i, t) for i, t in want.items() if i in kept], library, 1024)
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").exceptAll(seen["packing"][1].select("doc_id", "start", "length", "ids_crc32")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf_dir, odd, nothing, name, stage):
    assert stage(spark, nothing, sf_dir).count() == 0
    out = stage(spark, odd, sf_dir)
    assert name == "packing" or out.columns == odd.columns
    assert out.count() > 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
