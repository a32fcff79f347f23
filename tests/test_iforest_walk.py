"""The walk through the isolation trees: its sums, and that it is made once."""
import numpy as np
import pandas as pd

import __spark_entry__ as E
from data_paths import SF_SMALL
from storewatch.operators import iforest


def test_isolation_forest_walks_its_trees_once(spark):
    """Least and largest score and the rows read the written scores."""
    assert "MapInPandas" not in E.queries()["isolation_forest"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_path_sums_match_a_walk_row_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 4))
    x[::50, 1] = np.nan
    table = np.array([iforest._c(i) for i in range(600)])
    grown = [iforest._grow(pd.DataFrame({"tree": [t] * n, "x": list(rng.normal(size=(n, 4)))}), 4, 42) for t, n in enumerate((256, 100, 2, 1))]
    want = np.zeros(len(x))
    for tree in grown:
        nodes = tree.to_dict("records")
        for i, row in enumerate(x):
            at, depth = 0, 0
            while nodes[at]["feature"] >= 0:
                at = nodes[at]["left"] if row[nodes[at]["feature"]] < nodes[at]["threshold"] else nodes[at]["right"]
                depth += 1
            want[i] += depth + table[nodes[at]["size"]]
    got = iforest._path_sums(x, [iforest._walkable(tree, table) for tree in grown])
    assert (got == want).all()
