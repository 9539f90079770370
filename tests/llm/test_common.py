from pathlib import Path

import numpy as np
from tallymatch.llm.common import Scratch, summed, table
from tallymatch.llm.components import components
from tallymatch.llm.jaccard import CELLS, CHUNKS, _sum_counts
from tallymatch.plans.tables import shared_dir


def test_sums_in_steps(spark):
    """Rows of tasks beyond the bound of a group are summed up in several steps; narrow and wide counts mix."""
    m = CELLS // CHUNKS
    rows = [(k % 3, (np.arange(m) + k).astype(np.uint32).tobytes()) for k in range(90)] + [(3, np.ones(m, np.uint32).tobytes())]
    df = table(spark.createDataFrame(rows, "chunk int, counts binary"), "counts")
    got = {r["chunk"]: np.frombuffer(r["counts"], np.uint64) for r in summed(df, "chunk", _sum_counts, rows=4).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for c in range(3):
        assert (got[c] == 30 * np.arange(m) + sum(range(c, 90, 3))).all()
    assert (got[3] == 1).all()
    assert summed(df.limit(0), "chunk", _sum_counts).collect() == []


def test_scratch_tables_go(spark):
    """Tables of a scratch are deleted with it, and components leave none but the one that they return."""
    folder = Path(shared_dir(spark).removeprefix("file://")) / "tallymatch"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    scratch = Scratch()
    scratch.table(spark.range(5), "numbers")
    labels = components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src long, dst long"))
    scratch.clear()
    assert sorted(map(tuple, labels.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert {p.name.split("-")[0] for p in folder.iterdir() if p.name not in before} == {"labels"}
