"""The pipeline against its stages' brute force on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers as P
import sentencepiece
from test_dedup import components, simhash
from test_text_operators import cut

D = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    rated = corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{D}/documents.parquet"), D)
    assert rated.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r["doc_id"] for r in rated.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert all(i in left for i, q in labels.items() if q == 1)
    rows = [r for r in docs if r[0] in left]
    last = {t: i for i, t, _ in sorted(rows)}
    rows = [r for r in rows if last[r[1]] == r[0]]
    fps = {i: simhash(t) for i, t, _ in rows}
    group = components(sorted(fps), [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
    rows = [r for r in rows if group[r[0]] == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    # By the words themselves: a document with all words of a window in order, or of a shorter item, is out.
    lines = [" " + " ".join(cut(t)) + " " for _, t in items]
    wanted = {" " + " ".join(w[i : i + 8]) + " " for w in map(str.split, lines) if w for i in range(max(1, len(w) - 7))}
    texts = {i: " " + " ".join(cut(t)) + " " for i, t, _ in rows}
    bad = {i for i, line in texts.items() if any(w in line for w in wanted)}
    assert bad
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: model.encode(t) for i, t, _ in rows if i not in bad}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, D).collect()}
    assert got == want


def test_stages_of_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
