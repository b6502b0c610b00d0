"""Connected components of a table of links, without the driver or a hub's task holding them.

Two exact ways share one result. Each partition first keeps spanning forests of
bounded numbers of its links (union-find). What is left fits one bounded task up to ``SMALL`` links;
beyond that, large-star and small-star rounds (Kiveris et al. 2014) run over
written tables until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, written

#: Links that one task unites: 16 bytes each on the wire, some 200 in its tables.
SMALL = 1_000_000
#: Links of a partition that are united at a time.
PIECE = 500_000


class Forest:
    """Union-find by smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def unite(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def links(self) -> tuple[list[int], list[int]]:
        """(member, smallest member), smallest members left out."""
        pairs = [(x, self.root(x)) for x in list(self.up)]
        return [x for x, r in pairs if x != r], [r for x, r in pairs if x != r]


def _forest(most: int):
    """The links of a spanning forest of every ``most`` links of a partition."""

    def told(forest: Forest) -> Iterator[pa.RecordBatch]:
        a, b = forest.links()
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x[i : i + 50_000], np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, n = Forest(), 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.unite(a, b)
            n += batch.num_rows
            if n >= most:
                yield from told(forest)
                forest, n = Forest(), 0
        yield from told(forest)

    return run


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """links: long columns a and b. Returns node, component (the smallest node reachable), without lone nodes."""
    links = written(links.select("a", "b").where("a <> b").mapInArrow(tidied(_forest(PIECE)), "a long, b long"), "links")
    if links.count() <= small:
        united = links.repartition(1).mapInArrow(tidied(_forest(2 * small + 1)), "a long, b long")
        stars = written(united, "stars")
    else:
        stars = _stars(links)
    return stars.selectExpr("a AS node", "b AS component").unionByName(stars.selectExpr("b AS node", "b AS component").distinct())


def _stars(links: DataFrame) -> DataFrame:
    """Rounds of large star and small star; ends with (member, smallest member)."""
    before = None
    while True:
        both = links.select("a", "b").unionByName(links.selectExpr("b AS a", "a AS b"))
        links = _star(both, "b > a")
        links = _star(links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b"), "b <= a")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return links
        before = now


def _star(directed: DataFrame, kept: str) -> DataFrame:
    """Every neighbour that passes ``kept`` linked to its node's smallest neighbour (or the node), and for small stars the node too."""
    directed = written(directed.distinct(), "directed")
    # Written, so that the join has an exchange on either side and a hub's links can be split.
    least = written(directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    met = directed.join(least, "a")
    out = met.where(kept).selectExpr("b AS a", "least AS b")
    if kept == "b <= a":
        out = out.unionByName(least.selectExpr("a", "least AS b"))
    return written(out.where("a <> b").distinct(), "star")
