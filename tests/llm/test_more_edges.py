"""Texts over a megabyte, ties, clashing columns, empty tables through the pipeline, and one automaton alive at a time."""

import gc
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.llm import decontaminate, jaccard, licenses, lm, neighbours, quality, toxicity
from isochron.llm.common import cut

HUGE = "plenty of quite ordinary words in a row number " * 26_000  # 1.2 MB


@pytest.fixture(scope="module")
def long_docs(spark):
    texts = [(1, HUGE + "all rights reserved " + "the exact benchmark passage of ten words that we look for"), (2, HUGE + "all rights reserved"), (3, "short and clean"), (4, "x" * 1_200_000), (5, "! " * 600_000)]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(2)


def test_texts_over_a_megabyte(spark, long_docs):
    """Whole texts count, their last words too."""
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 6)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("a", "the exact benchmark passage of ten words that we look for")], "item_id string, text string")
    words = 26_000 * 9
    found = {r["doc_id"]: r for r in licenses.scan(long_docs).collect()}
    assert (found[2]["n_words"], found[2]["first_word"], found[2]["base_labels"]) == (words + 3, words, "reserved")
    hit = {r["doc_id"]: r for r in decontaminate.report(long_docs, benchmark).collect()}
    assert (hit[1]["n_hit"], hit[1]["n_words"], hit[2]["n_hit"], hit[4]["n_words"]) == (11, words + 14, 0, 1)
    same = {r["doc_id"]: r for r in jaccard.join(long_docs).collect()}
    assert same[2]["n_links"] == 0 or same[1]["component_id"] == same[2]["component_id"]
    tokens = {r["doc_id"]: r["n_tokens"] for r in lm.report(long_docs).collect()}
    assert tokens == {1: words + 15, 2: words + 4, 3: 4, 4: 2, 5: 600_001}
    for report in (quality.report, toxicity.report):
        assert all(0 <= r["score"] <= 1 for r in report(long_docs, labels).collect())


def test_equal_similarities_and_odd_columns(spark):
    """Forty vectors at one similarity from each other, more than a list holds, under column names that the join uses."""
    base = [[1.0] + [0.3 if j == k else 0.0 for j in range(40)] for k in range(40)]
    far = [[0.0] * k + [-1.0] + [0.0] * (40 - k) for k in range(1, 6)]
    rows = [(k, v, 0, k, "x", 7) for k, v in enumerate(base + far)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id long, component string, links int")
    by = {r["vec_id"]: r for r in neighbours.join(table).collect()}
    assert [by[k]["n_links"] for k in range(40)] == [39] * 40 and {by[k]["component_id"] for k in range(40)} == {0}
    assert [by[k]["n_links"] for k in range(40, 45)] == [0] * 5


def test_equal_scores(spark):
    """Documents of one text have one score and one side of the cut, whatever their number."""
    rows = [(k, "the same plain words for all of these") for k in range(30)] + [(k, "||| $$ !! &&& ###") for k in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 30), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    out = quality.report(docs, labels).collect()
    assert len({r["score"] for r in out if r["doc_id"] < 30}) == 1 and len({r["predicted"] for r in out if r["doc_id"] < 30}) == 1
    kept = quality.keep(docs, quality.fit(docs, labels)).groupBy("text").count().collect()
    assert {r["count"] for r in kept} == {30}


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "taken"} <= set(out.columns)


def test_one_automaton_at_a_time(spark, monkeypatch):
    """A benchmark of six automata: when one is built, those before it are gone; the finds are those of a single one."""
    alive, most = weakref.WeakSet(), []
    build = decontaminate.Automaton.__init__

    def counted(self, *args, **more):
        gc.collect()
        most.append(len(alive))
        alive.add(self)
        build(self, *args, **more)

    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(6)]
    docs = spark.createDataFrame([(k, f"some words {t} and more {items[(k + 1) % 6][1]}") for k, (_, t) in enumerate(items)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    whole = sorted(map(tuple, decontaminate.report(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate.Automaton, "__init__", counted)
    parts = decontaminate.report(docs, benchmark, max_words=12)
    assert len(most) == 6 and max(most) <= 1
    assert sorted(map(tuple, parts.collect())) == whole and all(r[2] == 24 for r in whole)
    assert parts.filter(F.col("n_items") != 2).count() == 0


def test_vectors_of_many_lengths_in_one_run(spark):
    """Lengths are parts of the keys: six lengths take about as many jobs as one, and link within themselves only."""
    random = np.random.default_rng(21)
    rows, links = [], {}
    for dim in range(8, 20, 2):
        x = np.concatenate([random.standard_normal((12, dim)), np.repeat(random.standard_normal((1, dim)), 25, 0) + 0.02 * random.standard_normal((25, dim))])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = unit @ unit.T >= 0.9
        for v, n in zip(x, linked.sum(1) - 1, strict=True):
            links[len(rows)] = int(n)
            rows.append((len(rows), v.tolist()))

    def jobs(wanted) -> tuple[int, dict]:
        group = f"lengths-{len(wanted)}"
        spark.sparkContext.setJobGroup(group, group)
        out = {r["vec_id"]: r["n_links"] for r in neighbours.join(spark.createDataFrame(wanted, "vec_id long, embedding array<double>")).collect()}
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, out

    one, _ = jobs(rows[:37])
    six, out = jobs(rows)
    assert out == links
    assert six < 2 * one


def test_saturated_lists_are_enlarged(spark):
    """A group of 30 saturates lists of 10; enlarged to 40, they hold every link of it, so no class stays saturated."""
    random = np.random.default_rng(22)
    x = np.concatenate([*(c + 0.02 * random.standard_normal((30, 16)) for c in random.standard_normal((6, 16))), random.standard_normal((200, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = cut(spark.createDataFrame([(i, v.tobytes(), v.astype(np.float32).tobytes()) for i, v in enumerate(x)], "id long, unit binary, vector binary"))
    graph = neighbours.start(classes, {16: len(x)}, 10, {16: range(8)}, 0, 8)
    full = neighbours.saturated(graph, 0.9, 10)
    assert {r["id"] for r in full.collect()} == set(range(180))
    for size, wider in ((10, 20), (20, 40)):
        full = cut(neighbours.saturated(graph, 0.9, size))
        for _ in range(3):
            graph = neighbours.descend(graph, classes.select("id", "vector"), 10, wider, full)
    assert neighbours.saturated(graph, 0.9, 40).isEmpty()
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    counts = {r["a"]: r["count"] for r in neighbours.linked(graph, 0.9).groupBy("a").count().collect()}
    assert counts == {i: int(n) for i, n in enumerate(linked.sum(1)) if n}


def test_parts_with_saturated_lists_are_bridged(spark):
    """Without enlarging, two tight groups at a cosine of 0.93 know of each other by their balls only."""
    random = np.random.default_rng(23)
    axes = np.linalg.qr(random.standard_normal((24, 24)))[0]
    centres = [axes[0], 0.945 * axes[0] + np.sqrt(1 - 0.945**2) * axes[1]]
    x = np.concatenate([*(c + 0.01 * random.standard_normal((20, 24)) for c in centres), random.standard_normal((60, 24))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in neighbours.join(table, audit=0, enlarged=()).collect()}
    assert [out[i]["n_links"] for i in range(100)] == [39] * 40 + [0] * 60
    assert {out[i]["component_id"] for i in range(40)} == {0}
