"""Links between sets of a full block whose ends have links elsewhere."""

import numpy as np

from orrery.llm import simhash


def test_linked_sets_of_a_full_block_are_compared(spark):
    """0 and 1 are similar and share a full block only. Its leader is like neither, and each has a link of its own through a small block."""
    sets = {0: (range(100, 200), ["full", "x"]), 1: (range(108, 208), ["full", "y"]), 2: (range(90, 190), ["x"]), 3: (range(118, 218), ["y"])}
    sets |= {i: (range(1000 * i, 1000 * i + 100), ["full", "other"]) for i in range(4, 4 + simhash.SMALL + 1)}
    number = {"full": 1, "other": 2, "x": 3, "y": 4}
    spread = lambda r: np.sort(np.array(r, "u8") * 2654435761 % (1 << 32)).astype("<u4").tobytes()
    nodes = [(i, 100, 0, [number[k] for k in keys], spread(r)) for i, (r, keys) in sets.items()]
    d = spark.createDataFrame(nodes, "seq long, n long, fp long, keys array<long>, shingles binary").repartition(3)
    got = {(r["node"], r["component"]) for r in simhash.components(simhash._similar_pairs(d, 0.8)).collect()}
    assert got == {(1, 0), (2, 0), (3, 0)}
