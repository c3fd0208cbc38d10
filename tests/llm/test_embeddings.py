import math

import numpy as np
import pytest
from brute import roots

from veilscribe.llm import embeddings, queries


def expected(rows, least=0.95):
    units = []
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least]
    root, degree, smallest = roots(edges, range(len(rows))), [0] * len(rows), {}
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    for k, (i, _) in enumerate(rows):
        smallest[root[k]] = min((x for x in (smallest.get(root[k]), i) if x is not None), default=None)
    return sorted(str((i, degree[k], smallest[root[k]], i == smallest[root[k]])) for k, (i, _) in enumerate(rows))


def test_op4_is_brute_force(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert sorted(str(tuple(r)) for r in queries.op4_embeddings(spark, data).collect()) == expected(rows)


def test_op4_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_NUMBERS", 512)
    draw = np.random.default_rng(6)
    base = draw.normal(size=(40, 16))
    rows = [(i, base[i % 40] + draw.normal(size=16) * draw.choice([0, 0.05, 0.2, 0.4])) for i in range(260)]
    rows = [(i, v.tolist()) for i, v in rows] + [(300 + k, (base[3] * 2.0**k).tolist()) for k in range(20)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [math.nan] * 16), (404, [math.inf] + [1.0] * 15), (405, [None] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (None, base[5].tolist()), (1, base[7].tolist()), (408, [1e-300] * 16), (409, [1e300] * 16)]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, kept string").repartition(3)
    assert sorted(str(tuple(r)) for r in embeddings.near_duplicates(frame).collect()) == expected(rows)
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="least"):
        embeddings.near_duplicates(frame, least=1.5)


def test_bounds_hold():
    draw = np.random.default_rng(8)
    units = draw.normal(size=(300, 24)) * draw.choice([1, 10, 100], size=(300, 24))
    units /= np.linalg.norm(units, axis=1)[:, None]
    q, scale, error, norm = embeddings.quantise(units)
    near = (q.astype(float) @ q.astype(float).T) * scale[:, None] * scale[None]
    assert (np.abs(units @ units.T - near) <= error[:, None] * norm[None] + error[None] + 1e-12).all()


def test_work_is_every_pair_of_stripes_of_a_length():
    stripes = np.array([3, 1, 5])
    cells = stripes * (stripes + 1) // 2
    found = [embeddings._cell(k, cells, stripes) for k in range(int(cells.sum()))]
    assert found == [(kind, left, right) for kind, n in enumerate(stripes) for left in range(n) for right in range(left, n)]


def test_a_task_holds_as_much_for_any_number_of_vectors(spark, monkeypatch):
    """Of some 2,000 blocks no task has more than a stripe and a block at a time."""
    monkeypatch.setattr(embeddings, "BLOCK_NUMBERS", 64)
    draw = np.random.default_rng(9)
    base = draw.normal(size=(90, 1))
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(5 * 64)] + [(1000 + k, [float(x)] * 2) for k, x in enumerate(base[:, 0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(str(tuple(r)) for r in embeddings.near_duplicates(frame).collect()) == expected(rows)
    for blocks in (1, 10, 100, 2_000, 10**7):
        assert 1 <= int(np.clip(blocks // (4 * embeddings.STRIPE), 1, embeddings.STRIPE)) <= embeddings.STRIPE


def test_units_are_one_by_one():
    import pyarrow as pa

    rows = [[3.0, 4.0], None, [], [0.0, 0.0], [1.0, None], [math.nan, 1.0], [1.0], [1e-320, 0.0], [1e308, 1e308], [-2.0, 0.0, 1.0]]
    found = embeddings.units(pa.array(rows, pa.list_(pa.float64())).slice(0))
    assert [x is None for x in found] == [False, True, True, True, True, True, False, False, False, False]
    assert np.frombuffer(found[0]).tolist() == [0.6, 0.8] and np.frombuffer(found[7]).tolist() == [1.0, 0.0]
    assert embeddings.units(pa.array(rows, pa.list_(pa.float64())).slice(6)) == found[6:]
