"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

from isochron.llm import decontaminate, jaccard, licenses, lm, mixing, neighbours, pii, quality, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, words long, hash long, bucket int, id long, at int, c0 string, hit_spans string, pii_found string, score double, n_entities long"
LONG = "long word sequence number " * 5000


def rows():
    texts = [(1, "Some text with words all rights reserved."), (2, None), (3, ""), (None, "null id text here"), (1, "Some text with words all rights reserved."), (4, LONG), (5, "!!! ??? ..."), (6, "Mail anna.12@host.example.com now"), (7, "some text with WORDS all rights reserved"), (8, "KKelvin İ cc by")]
    return [(i, t, "en", None if i == 5 else f"s{(i or 0) % 2}", len(t or ""), "x", 1, 2, 3, 4, 5, "c", "h", "p", 0.5, 9) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("a", "some text with words"), ("b", None), (None, "reserved"), ("c", ""), ("c", "long word sequence number long word sequence number long word sequence")], "item_id string, text string")


def reports(labels, benchmark):
    return {
        "1": licenses.scan, "2": lambda d: pii.replace(d, "key"), "3": lambda d: toxicity.report(d, labels), "5": mixing.mix, "6": suffix.report,
        "7": lambda d: quality.report(d, labels), "8": lm.report, "9": lambda d: decontaminate.report(d, benchmark), "10": jaccard.join,
    }


@pytest.mark.parametrize("name", ["1", "2", "3", "5", "6", "7", "8", "9", "10"])
def test_one_row_for_each_document(name, docs, none, labels, benchmark):
    report = reports(labels, benchmark)[name]
    out = report(docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows())
    assert report(none).count() == 0


def test_licenses_of_odd_texts(docs):
    by = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (by[1]["n_base"], by[1]["first_word"], by[1]["base_labels"]) == (1, 4, "reserved")
    assert (by[2]["n_words"], by[2]["n_base"], by[2]["first_word"], by[2]["labels"]) == (0, 0, None, "")
    assert (by[8]["n_words"], by[8]["base_labels"]) == (4, "cc-by")  # the Kelvin sign is no k


def test_stages_keep_columns(docs, none, labels, benchmark):
    assert decontaminate.remove(docs, benchmark).columns == docs.columns
    assert pii.replace(docs, "key", counts=False, chars="n_chars").columns == docs.columns
    for table in (docs, none):
        assert decontaminate.remove(table, benchmark).count() <= table.count()
        assert quality.keep(table, quality.fit(docs, labels)).columns == docs.columns
    kept = {r["doc_id"]: r for r in decontaminate.remove(docs, benchmark).collect()}
    assert kept[3]["text"] == "" and kept[2]["text"] is None and kept[5]["text"] == "!!! ??? ..."
    assert 4 not in kept  # it is all benchmark
    assert decontaminate.report(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_pipeline_stages(spark, docs, none):
    """Repeated rows, null ids and texts, empty tables and odd columns in the stages that group and mix."""
    import corpus_pipeline

    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    # 7 has the words of 1, the two equal rows of 1 leave one; what has no words or no id stays.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 4, 5, 6, 8]))
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0
    mixed = corpus_pipeline.source_mix(spark, docs, "").collect()
    assert {r["doc_id"] for r in mixed} <= {1, None, 4, 5, 6, 7, 8} and all(0 < r["taken"] <= 2 * r["size"] for r in mixed)
    assert corpus_pipeline.source_mix(spark, none, "").count() == 0


def test_contradicting_labels(spark, docs):
    """An id that is labelled both ways counts for neither side, in whatever order its labels come."""
    many = spark.createDataFrame([(i, f"plain words number {i} and more of them" if i % 2 else "||| $$ !! &&& ###") for i in range(60)], "doc_id long, text string")
    good = [(i, i % 2, i % 2) for i in range(60)]
    scores = []
    for extra in ([(1, 0, 0), (3, 0, 0)], [(3, 0, 0), (1, 0, 0)]):
        labels = spark.createDataFrame(extra + good if extra[0][0] == 1 else good + extra, "doc_id long, quality int, toxic int")
        scores.append(sorted(tuple(r) for r in quality.report(many, labels).collect()))
        assert quality.sample(many, labels, "quality").count() == quality.sample(many, labels.filter("doc_id not in (1, 3)"), "quality").count()
    assert scores[0] == scores[1]


def test_no_folder_of_one_machine(spark, monkeypatch):
    from isochron.llm import common

    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", lambda self: {}, lambda self: None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, key, other=None: other})()

    with pytest.raises(ValueError):
        common.checkpoint_dir(Session())


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (1, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, label int")
    out = neighbours.join(table).collect()
    assert len(out) == len(vectors)
    by = {r["vec_id"]: r for r in out}
    assert [by[k]["n_links"] for k in (2, 9, 3, 5, 6, 7, 8, 10, 11)] == [3, 3, 0, 0, 0, 0, 0, 0, 0]
    assert by[2]["component_id"] == by[9]["component_id"] == 1 and not by[2]["kept"] and by[3]["kept"]
    assert neighbours.join(table.limit(0)).count() == 0
