import numpy as np
import pyarrow.parquet as pq
import pytest

from isochron import queries
from isochron.operators import matching


def mutual(ids, x):
    """Brute force; distances are added in the order of the components, ties go to the smaller id."""
    best = {}
    for k, i in enumerate(ids):
        far = np.zeros(len(ids))
        for c in range(x.shape[1]):
            far += (x[k, c] - x[:, c]) ** 2
        d, j = min(((d, j) for d, j in zip(far.tolist(), ids, strict=True) if j != i), default=(None, None))
        best[i] = j
    return {(i, j) for i, j in best.items() if j is not None and best[j] == i}


def test_every_label_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, labels, x = table["vec_id"].to_numpy(), table["label"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    want = {(int(n), *p) for n in np.unique(labels) for p in mutual(ids[labels == n].tolist(), x[labels == n])}
    got = [tuple(r) for r in queries.QUERIES["vec_pairs"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({n for n, *_ in want}) > 1
    assert {tuple(r) for r in queries.QUERIES["vec_pair"](spark, sf_dir).collect()} == {(a, b) for _, a, b in want}


@pytest.mark.parametrize("rows", [7, 2_048])
def test_blocks_copies_and_odd_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(matching, "BLOCK_ROWS", rows)
    random = np.random.default_rng(3)
    x = random.integers(-2, 3, (120, 3)).astype(float)  # many ties and copies
    ids = random.permutation(120).tolist()
    labels = ["a" if k % 4 else "b" for k in range(118)] + ["c", "c"]
    rows = [(i, n, v.tolist()) for i, n, v in zip(ids, labels, x, strict=True)]
    odd = [(500, "a", None), (501, "a", []), (502, "a", [float("nan"), 0.0, 0.0]), (503, "a", [0.0, None, 0.0]), (504, None, [0.0, 0.0, 0.0]), (505, "a", [1.0, 2.0]), (506, "d", [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, label string, embedding array<double>").repartition(4)
    got = [tuple(r) for r in matching.mutual_nearest(table, "label", "vec_id", "embedding").collect()]
    want = {(n, *p) for n in "abc" for p in mutual([i for i, m in zip(ids, labels, strict=True) if m == n], x[[m == n for m in labels]])}
    assert len(got) == len(set(got)) and set(got) == want
    assert matching.mutual_nearest(table.limit(0), "label", "vec_id", "embedding").count() == 0
