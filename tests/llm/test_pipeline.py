"""The stages of the corpus pipeline, each on its predecessor's rows."""


def test_stages(spark, sf_dir):
    import corpus_pipeline as p
    from terraloom.llm.common import staged
    from test_text_operators import components_brute, fingerprint_brute, lines_brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = staged(stage(spark, docs, sf_dir), name)
        seen[name] = docs.count()
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line_dedup":
            import hashlib

            want = {d: h for d, _, _, h in lines_brute(list(before.items()))}
            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()} == want
        if name == "near_dedup":
            fps = {d: fingerprint_brute(t) for d, t in before.items()}
            roots = components_brute(fps.values())
            least = {}
            for d, f in fps.items():
                least[roots[f]] = min(least.get(roots[f], d), d)
            assert set(after) == set(least.values())
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            exact = {d for d, t in before.items() if any(" ".join(x.lower().split()) in " ".join(t.lower().split()) for x in items)}
            assert not exact & set(after) and len(after) >= 0.9 * (len(before) - len(exact))
    assert p.run(spark, sf_dir).count() == seen["packing"]
