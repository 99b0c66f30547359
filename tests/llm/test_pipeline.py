import corpus_pipeline
from faultline.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from llm_tables import listed


def test_stages_work_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
        if name != "packing":
            assert kept[-1].columns == columns
    toxic = {r["doc_id"] for r in listed(toxicity.score(docs, model)) if r["predicted"]}
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == ids[0] - toxic
    assert ids[2] == {r["doc_id"] for r in listed(exact_dedup.duplicate_groups(kept[1])) if r["kept"]}
    assert ids[3] == {r["doc_id"] for r in listed(near_dedup.near_duplicates(kept[2], near_dedup.CORPUS_PERCENT)) if r["kept"]}
    assert ids[4] == ids[5] == ids[3]
    for before, after in ((0, 1), (1, 2), (2, 3)):
        texts = {r.doc_id: r.text for r in kept[before].collect()}
        assert all(texts[r.doc_id] == r.text for r in kept[after].collect())
    spans = [len(r["spans"]) for r in listed(secret_scan.scan(kept[4]))]
    assert sum(spans) == 0
    run = listed(corpus_pipeline.run(spark, sf))
    assert sorted(map(repr, run)) == sorted(map(repr, listed(kept[5])))
    assert {r["sequence"] for r in run if r["n_tokens"] < packing.LONGEST}
