"""The pipeline's stages on a small input."""

import hashlib
import random


def test_stages_in_order(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["".join(rng.choice(["th", "an", "er", "on", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts = [say(80) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[3]), (51, f"{say(30)} {passage} {say(30)}"), (52, "short"), (53, None), (54, say(40) + " mail a.b@mail.example.com"), (55, " ".join(w + "%%%" for w in say(60).split()))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i == 55 else 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "pii", "subword ids"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(20), 54} and all(out[i].text == texts[i] and out[i].ids for i in range(20))
    assert out[54].text.endswith(" mail [EMAIL]") and out[54].n_chars == len(out[54].text)


def test_last_stage_decodes_its_ids(spark):
    import corpus_pipeline

    texts = ["the water  and\nthe stone", "", None, "\u65e5\u672c \u00e9 \u2581x\U0001f600"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.decoded_chars, r.decoded_sha256) for r in corpus_pipeline.subword_ids(spark, docs, "").collect()}
    assert out == {i: (None, None) if t is None else (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}


CLASHES = "doc_id long, text string, lang string, n_chars int, ids string, decoded_chars string, _kept string, _carried string, hits string, w string, _row string, row string, doc string, removed string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, nulls in every column, clashing names, one very long text; then nothing at all."""
    import corpus_pipeline

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, long = say(60), say(60), say(60), " ".join(f"{rng.choice(words)}{i % 977}" for i in range(60_000))
    mine = [(1, a), (1, b), (None, c), (None, c), (2, a), (3, None), (3, ""), (4, long), (5, " \n\t "), (6, b)]
    rows = [(i, t, None, len(t) if t else None, *["x"] * 10) for i, t in mine]
    for name, docs in (("odd", spark.createDataFrame(rows, CLASHES)), ("none", spark.createDataFrame([], CLASHES))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, None), (77, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None), (None, ""), (2, say(40))], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    names = CLASHES.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(out.columns) == sorted([*names, "decoded_sha256"])
    got = out.collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, c), (4, long)])
    assert all(r.decoded_chars == len(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r._kept == "x" and len(r.ids) > 50 for r in got)
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.count() == 0 and none.columns == out.columns
