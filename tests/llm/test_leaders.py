"""Rows of the n-gram Jaccard join's groups, cut into batches at random, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from siltworks.llm import jaccard


@pytest.mark.parametrize("seed", range(8))
def test_runs_lose_no_pair_that_sizes_allow(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        drawn = sorted({(int(rng.integers(0, 4)), int(rng.integers(2, 60))) for _ in range(rng.integers(1, 120))})
        rows = [(token, n, cls) for cls, (token, n) in enumerate(drawn)]
        rows = sorted(rows + [r for r in rows if rng.random() < 0.3])  # copies from other tasks
        cuts = [0, *sorted(rng.integers(0, len(rows) + 1, rng.integers(0, 12)).tolist()), len(rows)]
        name = lambda c: c.to_bytes(16, "little")
        batches = [pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows[x:y]], pa.int64()) for k in range(2)], pa.array([name(r[2]) for r in rows[x:y]], pa.binary())], ["token", "n", "cls"]) for x, y in zip(cuts, cuts[1:], strict=False)]
        groups: dict[int, set] = {}
        for out in jaccard._leaders(iter(batches)):
            for token, cls in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                groups.setdefault(token, set()).add(int.from_bytes(cls, "little"))
        met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
        wanted = {(a, b) for t, n, a in rows for u, m, b in rows if a < b and t == u and jaccard.DEN * n >= jaccard.NUM * m}
        assert wanted <= met
