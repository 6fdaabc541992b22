"""Trees beyond the limits of recursive SQL."""

import pytest

from quillspark.operators import conversation


def test_deep_trees(spark):
    """A chain beyond 1,000 levels and 1,000,000 rows of paths comes whole; a cycle is refused."""
    n = 1500
    chain = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end as parent_id")
    whole = (n * (n + 1) // 2, n - 1, (n - 1) * n * (n + 1) // 6)
    for got in (conversation.paths_to_root(chain, chain), conversation.subtrees(chain, chain)):
        assert tuple(got.selectExpr("count(*)", "max(depth)", "sum(depth)").first()) == whole
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 99)], "id long, parent_id long")
    assert sorted(map(tuple, conversation.paths_to_root(tree, tree.where("id > 3")).collect())) == [(4, 1, 2), (4, 2, 1), (4, 4, 0), (5, 5, 0)]
    assert sorted(map(tuple, conversation.subtrees(tree, tree.where("id = 1")).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)]
    with pytest.raises(ValueError):
        conversation.subtrees(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"), tree)
