import sentencepiece

import corpus_pipeline as pipeline
from loomstone.llm import pieces, quality
from tests.llm.test_simhash import shingle_set, survivors


def test_form():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_stages(spark, sf_dir, documents, tmp_path, monkeypatch):
    """Each stage on what the one before kept, against its rule told plainly."""
    monkeypatch.setattr(quality, "STEPS", 200)
    docs, kept = documents, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == documents.columns and out.schema == documents.schema
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.asDict() for r in docs.collect()])
    original = {r["doc_id"]: r["text"] for r in documents.collect()}
    good = {r["doc_id"] for r in kept[0]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    wrong = [i for i, y in labels.items() if (i in good) != (y == 1)]
    assert len(wrong) <= 0.1 * len(labels)
    # of documents that links of similarity 0.8 or more connect one stays, the one of the smallest id
    at = survivors([(i, original[i]) for i in good])
    least = {}
    for i in sorted(good):
        least.setdefault(at[shingle_set(original[i])], i)
    unique = {r["doc_id"] for r in kept[1]}
    assert unique == set(least.values()) and len(unique) < len(good)
    # no passage of 50 words stands in two documents, and nothing but passages is gone
    seen: dict = {}
    for r in kept[2]:
        w = r["text"].split()
        for j in range(len(w) - 49):
            assert seen.setdefault(tuple(w[j : j + 50]), r["doc_id"]) == r["doc_id"]
        assert r["n_chars"] == len(r["text"]) and (r["text"] == original[r["doc_id"]] or len(original[r["doc_id"]].split()) >= 50)
    # the mix takes no document more than twice and comes near its size
    times = {r["doc_id"]: sum(x["doc_id"] == r["doc_id"] for x in kept[3]) for r in kept[2]}
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert max(times.values()) <= 2 and abs(words(kept[3]) - 1.5 * words(kept[2])) < 0.1 * words(kept[2])
    # ids are the library's
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    texts = {r["doc_id"]: r["text"] for r in kept[3]}
    assert len(kept[4]) == len(kept[3]) and all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) for r in kept[4])


def test_odd_documents(spark, sf_dir, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 5)
    for docs in (odd_documents.select("doc_id", "text", "lang", "source", "n_chars"), no_documents.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in pipeline.STAGES:
            n = stage(spark, docs, sf_dir).count()
            assert n <= 2 * docs.count()


def test_documents_that_lose_all_words(spark):
    """They go, with or without white space before them; texts that had no words stay."""
    text = " ".join(f"word{i}" for i in range(60))
    texts = [text, text, "  " + text, "", " \t", None, "a few words"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in pipeline.substring_dedup(spark, docs, "").collect()} == {i: texts[i] for i in (0, 3, 4, 5, 6)}


def test_what_the_classifier_rejects_goes(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "fitted", lambda *a: None)
    monkeypatch.setattr(quality, "scored", lambda docs, network: docs.withColumn("score", F.col("n_chars") / 10.0))
    docs = spark.createDataFrame([(i, "t", "en", "s", i) for i in range(11)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.quality_classifier(spark, docs, sf_dir).collect()} == {7, 8, 9, 10}


def test_run(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 5)
    assert pipeline.run(spark, sf_dir).columns == ["doc_id", "lang", "source", "ids", "n_pieces"]


