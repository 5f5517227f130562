"""A corpus to look things up in: the operators behind a browsing tool, over nodes (act, path, title, own_text, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.operators import evidence as E
from stratiform.operators import judging as J


class Corpus:
    """Searches and lookups; excluded articles (act, article) are never shown."""

    def __init__(self, nodes: DataFrame, excluded: DataFrame | None = None) -> None:
        self.nodes = nodes if excluded is None else J.without_excluded(nodes, excluded)

    def search(self, pattern: str, acts: list[str] | None = None, in_titles: bool = False) -> DataFrame:
        """(act, path, pos, snippet) of every match in any case, in document order."""
        rows = self.nodes if acts is None else self.nodes.filter(F.col("act").isin(acts))
        keyed = rows.withColumn("id_", F.struct("act", "ordinal", "path"))
        found = E.search(keyed, "id_", "title" if in_titles else "own_text", pattern)
        return found.orderBy("id_", "pos").select("id_.act", "id_.path", "pos", "snippet")

    def titles(self, act: str) -> DataFrame:
        """Articles of an act by number."""
        return J.titles(self.nodes.filter(F.col("act") == act))

    def article(self, act: str, article: str) -> DataFrame:
        """An article's nodes in document order."""
        return self.nodes.filter((F.col("act") == act) & (F.substring_index("path", ".", 1) == article)).orderBy("ordinal")

    def lookup(self, ids: list[tuple[str, str]]) -> DataFrame:
        """Nodes by (act, path), in the order asked for; ``known`` is false for those the corpus doesn't hold."""
        spark = self.nodes.sparkSession
        asked = spark.createDataFrame([(k, *i) for k, i in enumerate(ids)], "pos int, act string, path string")
        return asked.join(self.nodes, ["act", "path"], "left").withColumn("known", F.col("ordinal").isNotNull()).orderBy("pos")
