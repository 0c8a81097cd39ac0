"""The pipeline's stages on the smallest tables: what each drops or changes, against brute force."""

import re

import corpus_pipeline
from isochron.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        stages.append(docs)
    assert all(s.columns == columns for s in stages[:-1])
    good, single, clean, safe, mixed = ({r["doc_id"]: r for r in s.collect()} for s in stages)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [i for i in good if labels.get(i) == 1]
    assert len(kept) >= 0.95 * sum(v == 1 for v in labels.values()) and sum(labels.get(i) == 0 for i in good) <= 0.1 * sum(v == 0 for v in labels.values())

    def shingles(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
        return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(r["text"]) for i, r in good.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    left = sorted(single)
    assert not any(near(a, b) for k, a in enumerate(left) for b in left[:k])
    assert all(any(near(a, b) for b in good if b < a) for a in good if a not in single)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.WORD.findall(r["text"].encode().lower())
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    has = lambda t: any(tuple(w[i : i + 10]) in windows for w in [decontaminate.WORD.findall(t.encode().lower())] for i in range(len(w) - 9))
    assert all(clean[i]["text"] == r["text"] for i, r in single.items() if not has(r["text"]))
    assert not any(has(r["text"]) for r in clean.values())
    for i, r in clean.items():
        found = re.findall(r"[\w.]+@[\w.]+\w|\b\d{16}\b|\b[0-9a-f]{40}\b", r["text"])
        assert all(f not in safe[i]["text"] for f in found) and (found or i in safe)
        assert safe[i]["n_chars"] == len(safe[i]["text"]) or safe[i]["text"] == r["text"]
    assert all(0 < r["taken"] <= 2 * r["size"] for r in mixed.values()) and set(mixed) <= set(safe)
