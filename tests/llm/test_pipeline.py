import corpus_pipeline
import __spark_entry__
from weftline.llm import decontaminate


def near_groups(texts):
    """doc_id -> least doc_id of its group, by the similarity of five-word shingle sets."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {d: grams(t) for d, t in sorted(texts.items())}
    label = {d: d for d in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (5 * len(a & b) >= 4 * len(a | b)):
                x, y = label[i], label[j]
                label = {d: min(x, y) if v in (x, y) else v for d, v in label.items()}
    return label


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    from weftline.llm.common import written

    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        seen.append(docs)
    language, near, passages, clean, packed = seen
    assert all(d.columns == columns for d in seen[:-1])
    assert language.count() == 200
    groups = near_groups({r["doc_id"]: r["text"] for r in language.collect()})
    assert {r[0] for r in near.select("doc_id").collect()} == set(groups.values())
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in bench.collect()])
    assert {r["doc_id"] for r in passages.collect() if not items.find(r["text"])} == {r["doc_id"] for r in clean.collect()}
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in clean.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == packed.count()


def test_rejects_and_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "some plain words of a text"), (4, "some plain words of a text"), (5, "1234 !!")])
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]
    assert corpus_pipeline.identify_language(spark, docs_of([]), "").count() == 0
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, kept, "").collect()] == [3]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and set(__spark_entry__.oracle_sql()) <= set(names)
