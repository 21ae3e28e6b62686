from __future__ import annotations

import random
import zlib

import numpy as np

from sciobs.llm import quality

from .helpers import awkward, documents, empty, sentence


def corpus(n=300):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = sentence(i, r.randrange(20, 200))
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), " ".join(w + "$$$" for w in text.split()), " ".join([text.split()[0]] * 80)])
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_contract(spark):
    rows, labels = corpus()
    truth = {i: q for i, q, _ in labels}
    got = quality.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_nothing_is_learned_from_held_out_labels(spark):
    rows, labels = corpus(60)
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    scores = [sorted((r["doc_id"], r["score"]) for r in quality.classify(documents(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flip)]
    assert scores[0] == scores[1]


def test_awkward_rows(spark):
    rows, labels = corpus(60)
    docs = documents(spark, rows + awkward()).withColumnsRenamed({"lang": "score", "source": "predicted"})
    got = quality.classify(docs, spark.createDataFrame(labels + [(None, 1, 0), (5, None, None), (2, 7, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + len(awkward())
    assert all(0 <= r["score"] <= 1 for r in got)


def test_empty_tables_and_one_label(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(empty(spark), none).count() == 0
    assert {r["score"] for r in quality.classify(documents(spark), none).collect()} == {0.5}


def test_every_passage_counts():
    good, bad = sentence(1, 2000).encode(), (b"!! " * 3000)
    x, many = quality.passages([good, bad, b"", good + bad])
    assert many.tolist() == [-(-len(t) // quality.PASSAGE) or 1 for t in (good, bad, b"", good + bad)]
    assert len(x) == many.sum()
    again, _ = quality.passages([good])
    assert np.array_equal(x[: many[0]], again)


def plain(model, text):
    """One document by the definition, passage by passage."""
    m = {k: v.astype(float) for k, v in model.weights.items()}
    cut = [text[i : i + quality.PASSAGE] for i in range(0, max(1, len(text)), quality.PASSAGE)]
    hidden, weight = [], []
    for passage in cut:
        h = np.tanh(quality.passages([passage])[0][0].astype(float) @ m["W"] + m["b"])
        hidden.append(h)
        weight.append(np.exp(m["w"] @ (np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"]))))))
    z = sum(w * h for w, h in zip(weight, hidden, strict=True)) / sum(weight)
    return 1 / (1 + np.exp(-(z @ m["c"] + m["d"][0])))


def random_model(kind=float):
    r = np.random.default_rng(1)
    shapes = {k: v.shape for k, v in quality.fit([], np.zeros(0)).weights.items()}
    return quality.Model({k: r.normal(0, 0.3, s).astype(kind) for k, s in shapes.items()})


def test_scores_against_brute_force(monkeypatch):
    model = random_model(np.float32)
    texts = [sentence(k, n).encode() for k, n in enumerate((1, 40, 300, 2500))] + [b"", b"ab", "日本語 é ".encode() * 400, b"!" * 512, b"!" * 513]
    want = [plain(model, t) for t in texts]
    assert np.allclose(model.score(texts), want, atol=1e-5)
    monkeypatch.setattr(quality, "CHUNK", 2 * quality.PASSAGE)  # every longer text in pieces
    assert np.allclose(model.score(texts), want, atol=1e-5)


def test_gradients_against_finite_differences():
    model, r = random_model(), np.random.default_rng(2)
    many = np.array([1, 3, 2, 5])
    x, labels = r.normal(size=(many.sum(), quality.WIDTH)), np.array([0.0, 1, 1, 0])

    def loss():
        h, *_, s = model.encode(x)
        y = model.pool(h, s, many)[-1]
        return -np.log(np.where(labels > 0, y, 1 - y)).mean()

    for name, grad in model.gradients(x, many, labels).items():
        w = model.weights[name]
        for at in map(tuple, r.integers(0, w.shape, (12, w.ndim))):
            old, step = w[at], 1e-5
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-6, (name, at)


def test_loss_falls():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(n, quality.WIDTH)).astype(np.float32) for n in (1, 3, 5, 2) * 8]
    labels, many = np.array([0, 1, 1, 0] * 8, np.float32), np.array([len(b) for b in bags])
    loss = []
    for epochs in (0, 5, 25):
        m = quality.fit(bags, labels, epochs)
        h, *_, s = m.encode(np.concatenate(bags))
        y = m.pool(h, s, many)[-1]
        loss.append(-np.log(np.where(labels > 0, y, 1 - y)).mean())
    assert loss[0] > loss[1] > loss[2]


def test_all_passages_of_a_labelled_document_are_learned_from(spark, monkeypatch):
    rows = [(i, sentence(i, 3000 if i % 4 else 20), "en", "s", 1) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    seen, model = [], random_model()
    monkeypatch.setattr(quality, "fit", lambda bags, y, **_: seen.append([len(b) for b in bags]) or model)
    quality.train(documents(spark, rows), labels)
    learned = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert seen[0] == [-(-len(rows[i][1]) // quality.PASSAGE) for i in learned]
    quality.train(documents(spark, rows), labels, most=100)
    assert sum(seen[1]) <= 100 and set(seen[1]) <= set(seen[0])


def test_a_document_repeated_thousands_of_times_is_learned_from_once(spark):
    from pyspark.sql import functions as F

    from sciobs.llm import mixing, shared

    rows, labels = corpus(60)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    hot = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)  # not held out
    again = docs.unionByName(docs.where(f"doc_id = {hot}").crossJoin(spark.range(10_000)).drop("id"))
    one, two = quality.train(docs, table), quality.train(again.repartition(5), table)
    assert all((one.weights[k] == two.weights[k]).all() for k in one.weights)
    domains = table.select("doc_id", F.col("quality").cast("string").alias("domain"))
    one, two = mixing.train(docs, domains), mixing.train(again.repartition(5), domains)
    assert (one.weights == two.weights).all() and (one.bias == two.bias).all()
    other = docs.where("doc_id < 4").unionByName(docs.where("doc_id = 3").withColumn("text", F.lit(None).cast("string")))
    kept = shared.one_text(other.select("doc_id", "text", "lang"), "lang").collect()
    assert sorted((r["doc_id"], r["text"] is None) for r in kept) == [(0, False), (1, False), (2, False), (3, True)]
