from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sciobs.llm import quality, tokens

from . import test_jaccard_join, test_line_dedup, test_packing
from .helpers import SCHEMA, awkward, sentence


def tables(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rows, labels = [], []
    shared_line = "this very line is in many of the documents here"
    for i in range(90):
        bad, toxic = i % 5 == 0, i % 5 == 1
        text = sentence(i % 80, 60) + "\n" + shared_line
        text = text.upper().replace(" ", "!! ") if bad else text
        rows.append((i, text + ("\nmoron idiot scum" if toxic else ""), "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    sf = tables(spark, tmp_path, rows + awkward(), labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    clean = {i for i in range(90) if i % 5 > 1}
    assert clean <= kept and len({i for i in range(0, 90, 5)} & kept) <= 2
    lines = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/1").collect() if shared_line in (r["text"] or "")]
    assert lines == [max(i for i in kept if i is not None and 11 < i < 90)]
    unique = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert not {i for i in range(80, 90)} & {i for i in unique if i is not None and i - 80 in unique and i % 5 != 0 and (i - 80) % 5 > 1}
    mixed = spark.read.parquet(f"{tmp_path}/3").collect()
    left = {i for i in clean if i in unique}
    assert len(left & {r["doc_id"] for r in mixed}) >= 0.95 * len(left)
    toxic = {i for i in range(1, 90, 5)} & unique
    assert len(toxic & {r["doc_id"] for r in mixed}) <= 0.5 * len(toxic)
    sequences = defaultdict(int)
    for r in docs.collect():
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= 2048


def test_stages_against_brute_force_with_clashing_columns(spark, tmp_path):
    """Each stage against its plain version on what the stage before kept; other columns follow their rows."""
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer_path())
    near, lines = test_jaccard_join.near_copies(5), test_line_dedup.shared_lines(6, 50)
    rows = [(k, text, "en", "s", len(text)) for k, text in enumerate([r[1] for r in near] + [r[1] for r in lines] + ["", sentence(77, 3_000)])]
    rows += [(1000 + k, sentence(400 + k, 50).upper().replace(" ", "!! "), "en", "s", 1) for k in range(20)]
    sf = tables(spark, tmp_path, rows, [(r[0], int(r[0] < 1000), int(r[0] % 9 == 0)) for r in rows])
    clashing = ("tokens", "posterior", "rate", "copies", "n_lines", "n_dropped", "digest", "component", "node", "sig", "score", "size")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(c), "doc_id") for c in clashing})
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model, "p").where("p >= 0.5").collect()}
    kept = [[tuple(r)[:5] for r in docs.collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/clash-{k}")
        docs = spark.read.parquet(f"{tmp_path}/clash-{k}")
        found = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
            assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in clashing), name
            kept.append([tuple(r)[:5] for r in found])
    assert {r[0] for r in kept[1]} == good and {r[0] for r in rows if r[0] < 1000} - {len(near) + len(lines)} <= good
    assert sorted((r[0], r[1]) for r in kept[2]) == sorted((i, text) for i, _, _, text in test_line_dedup.brute(kept[1]))
    assert all(r[4] == len(r[1]) for r in kept[2])
    assert sorted(r[0] for r in kept[3]) == sorted({c for _, c, _ in test_jaccard_join.brute(kept[2])}) and set(kept[3]) <= set(kept[2])
    assert set(kept[4]) <= set(kept[3])
    test_packing.check(found, kept[4], tokenizer, 2048)


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_run_is_the_stages(spark, tmp_path):
    sf = tables(spark, tmp_path, awkward(), [(5, 1, 0)])
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
