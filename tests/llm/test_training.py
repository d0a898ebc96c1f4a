"""What the toxicity field and the rules learn from: copies, whole texts, and nothing at all."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import crf, quality, rules, toxicity
from waymark.llm.queries import QUERIES


def corpus(spark, clean: int, toxic: int, copies: int, text: str):
    """Texts of 12 common words, toxic ones with 'vilest' among them, and copies of one toxic text."""
    rng = np.random.default_rng(3)
    common = [f"{a}{b}o" for a in "bcdfghklmn" for b in ("ari", "elu", "omi", "uta", "ine", "oru", "asi", "ebo", "ile", "una")]
    rows = []
    for i in range(clean + toxic):
        words = rng.choice(common, 12).tolist()
        if i >= clean:
            words.insert(6, "vilest")
        rows.append((i, " ".join(words), int(i >= clean)))
    rows += [(clean + toxic + i, text, 1) for i in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic"), common


def test_copies_leave_toxic_words_in_the_vocabulary(spark):
    letters = "abcdefghijklm"
    long = " ".join(f"z{a}{b}{c}y" for a in letters for b in letters for c in letters)  # 2,197 words of its own
    docs, labels, _ = corpus(spark, 600, 60, 100, long)
    assert "vilest" in toxicity.train(docs, labels).vocabulary


def test_copies_leave_the_base_rate(spark):
    docs, labels, common = corpus(spark, 600, 20, 900, "some zorgy text that is said over and over")
    model = toxicity.train(docs, labels)
    said = spark.createDataFrame([(1, f"{common[5]} vilest {common[8]} {common[9]}")], "doc_id long, text string")
    row = toxicity.score(said, model).collect()[0]
    assert [said.first()["text"][s["start"] : s["end"]] for s in row["spans"]] == ["vilest"]


def test_long_texts_are_one_chain():
    rng = np.random.default_rng(5)
    moves = np.array([[1.5, -2.0], [-2.5, 1.0]])
    lengths = [300, 0, 1, 129, 0, 128, 2]
    word = [rng.integers(0, 3, n) for n in lengths]
    field = toxicity.Model({"a": 1, "b": 2}, rng.normal(size=9), moves, np.zeros(3))
    bins = [rng.integers(0, sum(rules.SIZES), (n, len(rules.EDGES))) for n in lengths]
    lines = rules.Model(rng.normal(size=sum(rules.SIZES)), moves)
    for w, on, b, states in zip(word, field.tag(word), bins, lines.mark(bins)):
        n = len(w)
        assert len(on) == len(states) == n
        if n:
            side = np.concatenate([[0], w, [0]])
            emission = field.weight[side[1:-1]] + field.weight[3 + side[:-2]] + field.weight[6 + side[2:]]
            assert np.allclose(on, crf.marginals(emission[None], np.array([n]), moves)[0][0])
            assert (states == crf.viterbi(lines.weight[b].sum(1)[None], np.array([n]), moves)[0]).all()


def test_all_lines_of_a_labelled_document_are_learned(spark, monkeypatch):
    got, fit = [], rules.crf.fit
    monkeypatch.setattr(rules.crf, "fit", lambda active, state, length, *a, **b: got.append(int(length.sum())) or fit(active, state, length, *a, **b))
    docs = spark.createDataFrame([(i, "\n".join(f"line {k} of {i}" for k in range(20 + 37 * i))) for i in range(12)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    rules.train(docs, labels)
    used = quality.training_rows(docs, labels, "quality", 6_000).collect()
    assert max(r["doc_id"] for r in used) > 4 and set(got) == {sum(20 + 37 * r["doc_id"] for r in used)}  # lines alone, then chains


def test_queries_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i == 2 else " ".join(f"word{i}of{k}" for k in range(80)), "en") for i in range(6)], "doc_id long, text string, lang string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    labels = docs.selectExpr("doc_id", "0 as quality", "0 as toxic")
    for n_docs, n_labels in ((6, 0), (0, 6), (0, 0)):
        at = str(tmp_path / f"{n_docs}-{n_labels}")
        docs.limit(n_docs).write.parquet(f"{at}/documents.parquet")
        labels.limit(n_labels).write.parquet(f"{at}/labels.parquet")
        q4, q5, q7 = (QUERIES[q](spark, at).collect() for q in ("op4_quality", "op5_toxicity", "op7_quality_rules"))
        assert len(q4) == len(q5) == len(q7) == n_docs
        assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in q4) and all(abs(r["score"] - 0.01) < 1e-9 and r["predicted"] == 0 for r in q5)
        assert [r["kept"] for r in q7] == [r["n_words"] > 0 for r in q7]
        packed = corpus_pipeline.run(spark, at)
        assert packed.select("doc_id").distinct().count() <= n_docs and bool(packed.count()) == bool(n_docs)
