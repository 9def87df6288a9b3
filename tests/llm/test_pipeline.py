"""The pipeline's stages, each on what the one before has kept, against plain versions."""

import brute

import corpus_pipeline
from lodestone.llm import mixing, token_output, tokenizer
from lodestone.llm.common import materialise


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_output"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    def step(name, docs):
        out = materialise(stages[name](spark, docs, sf_dir), name)
        assert name == "token_output" or out.columns == columns
        return out, {r.doc_id: r.text for r in out.collect()} if name != "token_output" else None

    # too few labels at this size for a cutoff: only the base rules hold
    docs, kept = step("quality_rules", docs)
    assert kept.keys() == {x[0] for x in brute.quality(rows.items()) if not x[-1]}
    docs, single = step("near_dedup", docs)
    assert single.keys() == {x[0] for x in brute.near_dup(list(kept.items()), width=5) if x[3]}
    docs, clean = step("decontamination", docs)
    assert clean.keys() == {x[0] for x in brute.contaminated(list(single.items()), items) if not x[-1]}
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect()}
    docs, _ = step("mixing", docs)
    copies = {i: 0 for i in clean} | {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert copies == taken
    out, _ = step("token_output", docs)
    encode = tokenizer.encoder().encode
    want = sum(n * (len(encode(clean[i])) // 2 + 1) for i, n in copies.items())
    order = out.collect()
    assert sum(r.n_tokens for r in order) == want and sum(r.part == 0 for r in order) == sum(copies.values())
    assert {r.slot for r in order} == set(range(len({r.slot for r in order}))) and want <= len({r.slot for r in order}) * token_output.LENGTH


def test_odd_tables(spark, sf_dir):
    rows = [(0, None), (1, ""), (2, "a"), (None, "w " * 50), (4, " ".join(f"v{i}" for i in range(60))), (4, " ".join(f"v{i}" for i in range(60))), (5, "long " + " ".join(f"x{i}" for i in range(50_000)))]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null AS string) AS lang", "cast(null AS string) AS source", "7 AS print", "'k' AS kept", "1 AS copy", "2 AS doc")
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
            assert name == "token_output" or docs.columns == columns
            if name == "near_dedup":
                assert docs.count() <= 2  # the odd ones fail the rules, of the repeated row one stays
    assert docs.count() == 0


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["slot", "offset", "shard", "doc_id", "part", "n_tokens"]
