from __future__ import annotations

import random
from collections import defaultdict

import pytest

from sciobs.llm import line_dedup

from .helpers import awkward, documents, empty, sentence

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=20, docs=3):
    held = defaultdict(list)
    order = lambda i: -(2**63) if i is None else i
    for i, text, *_ in rows:
        for key in {x.strip(SPACE).translate(LOW) for x in (text or "").split("\n")}:
            if len(key) >= least:
                held[key].append(order(i))
    gone = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if order(i) >= gone.get(x.strip(SPACE).translate(LOW), order(i))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=lambda r: (order(r[0]), r[3]))


def run(spark, rows, **options):
    got = line_dedup.dedup_lines(documents(spark, rows), **options).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(map(tuple, got), key=lambda r: (-(2**63) if r[0] is None else r[0], r[3]))


def shared_lines(seed=2, n=60):
    r = random.Random(seed)
    pool = [sentence(k, 6) for k in range(12)] + ["ÀÉ shared line with accents Ü", "short line"]
    rows = []
    for i in range(n):
        lines = [r.choice(pool) if r.random() < 0.5 else sentence(1000 + 7 * i + k, 8) for k in range(r.randrange(1, 9))]
        lines = [("  \t" + x + " \r" if r.random() < 0.3 else x.upper() if r.random() < 0.2 else x) for x in lines]
        rows.append((i * 3, "\n".join(lines), "en", "s", 1))
    return rows


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 5, "fanout": 2}, {"min_docs": 2, "min_chars": 5}])
def test_against_brute_force(spark, options):
    rows = shared_lines()
    assert run(spark, rows, **options) == brute(rows, options.get("min_chars", 20), options.get("min_docs", 3))


def test_awkward_rows(spark):
    line = "one line that all of these rows hold"
    rows = awkward() + [(k, f"{line}\nown {k}\n{line}", "en", "s", 1) for k in (20, 21, 21, 22)] + [(None, line, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    rows = shared_lines(3, 9)
    docs = documents(spark, rows).withColumnsRenamed({"lang": "n_lines", "source": "hash", "n_chars": "id"})
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "hash", "id", "n_lines", "n_dropped"]
    assert out.count() == 9


def batches(spark, fanout=2):
    """Five batches of one row a hash: a in all, b in the first and third, each batch's own, c twice at once and then again."""
    runs = line_dedup.Runs(spark, 3, fanout)
    for k, holder in enumerate((9, 8, 7, 6, 5)):
        rows = [(b"a", 1, holder), (bytes([holder]), 1, holder)] + [(b"b", 1, holder)] * (k in (0, 2)) + [(b"c", 2, holder)] * (k in (1, 4)) + [(b"d", 3, holder)] * (k == 3)
        runs.add(spark.createDataFrame(rows, "hash binary, n long, holder long"), k)
    return runs, sorted((bytes(r["hash"]), r["holder"], r["batch"]) for r in runs.marks().collect())


def test_marks_settle_waiting_batches_through_compactions(spark):
    runs, marks = batches(spark)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert marks == [(b"a", 9, k) for k in range(5)] + [(b"c", 8, 1), (b"c", 8, 4), (b"d", 6, 3)]
    (old,), (new,) = ([spark.table(n).where("part = 'run'").collect() for n, _ in level] for level in (runs.levels[2], runs.levels[0]))
    state = {bytes(r["hash"]): (r["n"], r["holder"], list(r["waiting"])) for r in old}
    assert state[b"a"] == (3, 9, []) and state[b"b"] == (2, 9, [0, 2]) and state[b"c"] == (2, 8, [1]) and state[bytes([9])] == (1, 9, [0])
    # what is known to be repeated is not added again: only fresh hashes and those whose state changes
    assert sorted(bytes(r["hash"]) for r in new) == [bytes([5]), b"c"]
    runs.close()


def test_without_the_join_the_result_is_another(spark, monkeypatch):
    rows = shared_lines()
    assert run(spark, rows, batches=5) == brute(rows)
    monkeypatch.setattr(line_dedup.Runs, "known", lambda self, keys: keys.selectExpr("*", "CAST(null AS struct<n:long,holder:long,waiting:array<int>>) AS seen"))
    assert run(spark, rows, batches=5) != brute(rows)


def sizes(many, cuts):
    """Rows of each batch of ids from 0 to many - 1."""
    ends = [many - 1, *cuts, -1]
    return [a - b for a, b in zip(ends[:-1], ends[1:], strict=True)]


@pytest.mark.parametrize("many, batches", [(2_000, 3), (40_000, 4), (160_000, 6), (900_000, 9)])
def test_batches_double_so_runs_are_read_linearly(spark, many, batches):
    """Every batch is merged with all that came before it; together that is less than the corpus once."""
    held = sizes(many, line_dedup.cut(spark.range(many).withColumnRenamed("id", "doc_id"), None))
    assert len(held) == batches and sum(held) == many
    read = sum(sum(held[:k]) for k in range(len(held)))
    assert read <= 1.1 * many
    assert all(0.8 <= held[k] / sum(held[:k]) <= 1.25 for k in range(1, len(held)))


def test_an_id_with_a_third_of_all_rows_is_in_one_batch(spark):
    ids = spark.range(9_000).selectExpr("if(id % 3 = 0, 4500, id) AS doc_id")
    cuts = line_dedup.cut(ids, 6)
    assert cuts == sorted(set(cuts), reverse=True) and len(cuts) <= 5


def test_nothing_but_its_inputs_is_left(spark, tmp_path, monkeypatch):
    """Runs, marks and counts go when the lines to drop are written."""
    monkeypatch.setattr(line_dedup.shared, "shared_dir", lambda spark: str(tmp_path))
    assert run(spark, shared_lines(), batches=5, fanout=2) == brute(shared_lines())
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == ["line-marks", "lines"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_sql_agrees_on_repeated_and_null_ids(spark):
    import duckdb

    from sciobs.llm import queries

    line = "one line that all of these rows hold"
    rows = [(i, t, *rest) for i, t, *rest in shared_lines() + awkward()] + [(k, f"{line}\nown {k}\n{line}", "en", "s", 1) for k in (20, 21, 21, 22, 22)] + [(None, f"{line}\n{k}", None, None, None) for k in range(3)]
    docs = documents(spark, rows)
    done = line_dedup.dedup_lines(docs)
    got = sorted(map(str, done.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(cast(text as binary), 256)").toPandas().to_records(index=False).tolist()))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(queries.ORACLE_SQL["op3_line_dedup"]).df().astype({"doc_id": "float64"}).to_records(index=False).tolist()
    assert got == sorted(map(str, want))


def test_many_rows_without_id_are_not_one_group(spark):
    rows = [(None, f"line number {k % 7} that is shared\n{sentence(k, 5)}", "en", "s", 1) for k in range(40)] + [(1, f"line number {k} that is shared", "en", "s", 1) for k in range(7)]
    assert run(spark, rows) == brute(rows)
    hashes = line_dedup.line_hashes(documents(spark, rows))
    assert hashes.where(f"id = {-(2**63)}").select("key").distinct().count() == 40
