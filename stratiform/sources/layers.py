"""Readers of a corpus's layers: manifests, sources, node and chunk layers with staleness checks, runs with pinned hashes, frozen inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.sources.files import checked, read_jsonl, read_run

MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("document", T.StringType()), ("act", T.StringType()), ("role", T.StringType()), ("source_sha256", T.StringType()), ("size", T.LongType()), ("fetched_at", T.TimestampType()))])
#: Roles in the order in which they are preferred.
ROLES = ("consolidated", "original")


class Stale(ValueError):
    """What was read isn't what it says it was made from."""


def _refuse(problems: DataFrame, why: str) -> None:
    if bad := problems.limit(5).collect():
        raise Stale(f"{why}: {[r.asDict() for r in bad]}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest (JSON lines), each with a name, a role, a whole digest and a size."""
    rows = read_jsonl(spark, path, MANIFEST)
    return checked(rows, document=F.col("document") != "", role=F.col("role").isin(*ROLES), digest=F.col("source_sha256").rlike("^[0-9a-f]{64}$"), size=F.col("size") > 0)


def landed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(document, source_sha256, size): files of a landing folder, hashed by the executors; what a fetch would have recorded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("document"), F.sha2("content", 256).alias("source_sha256"), F.col("length").alias("size"))


def preferred(manifest: DataFrame) -> DataFrame:
    """One document an act: the consolidated text where there is one."""
    order = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return manifest.withColumn("place_", F.row_number().over(Window.partitionBy("act").orderBy(order, "document"))).filter("place_ = 1").drop("place_")


def read_layer(spark: SparkSession, path: str, schema: T.StructType, manifest: DataFrame, version: str) -> DataFrame:
    """A layer's rows (act, source_sha256, version, ...), nested or flat; another version, another source or an act that is missing is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    heads = rows.select("act", "source_sha256", "version").distinct()
    _refuse(heads.filter(~F.col("version").eqNullSafe(F.lit(version))), f"not of version {version}")
    sealed = manifest.select("act", F.col("source_sha256").alias("sealed"))
    _refuse(heads.join(sealed, "act", "full_outer").filter(~F.col("source_sha256").eqNullSafe(F.col("sealed"))), "not from the manifest's sources")
    return rows


def node_map(layer: DataFrame, articles: str = "articles") -> DataFrame:
    """(act, path, own_text, ...): the nodes of a nested layer (articles: array of struct with an array ``nodes``)."""
    return layer.select("act", F.explode(articles).alias("a_")).select("act", F.explode("a_.nodes").alias("n_")).select("act", "n_.*")


def run_digest(run: DataFrame) -> str:
    """SHA-256 of a run (query_id, rank, doc_id, score) in its order: every query's ranking is hashed where it lies, the driver hashes the queries' digests."""
    line = F.concat_ws("\t", "rank", "doc_id", F.format_string("%.9e", F.col("score").cast("double")))
    each = run.groupBy("query_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("h")).orderBy("query_id")
    total = hashlib.sha256()
    for r in each.toLocalIterator():
        total.update(f"{r.query_id}\t{r.h}\n".encode())
    return total.hexdigest()


def read_pinned_run(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A run that must be the one a summary names by its digest."""
    run = read_run(spark, path)
    if (found := run_digest(run)) != sha256:
        raise Stale(f"the run at {path} has the digest {found}, not {sha256}")
    return run


def read_system(spark: SparkSession, run: str, summary: str) -> tuple[DataFrame, dict]:
    """A system's run and its summary (one JSON object with ``identity.run_sha256``); the run must be the one the summary recorded."""
    held = spark.read.text(summary, wholetext=True).first()
    said = json.loads(held[0]) if held else {}
    if "run_sha256" not in said.get("identity", {}):
        raise Stale(f"{summary} names no run")
    return read_pinned_run(spark, run, said["identity"]["run_sha256"]), said


def read_frozen(spark: SparkSession, root: str, schemas: Mapping[str, T.StructType], sealed: Mapping[str, str], manifest: DataFrame, layer: str, version: str) -> dict[str, DataFrame]:
    """The tables of a benchmark folder (name.jsonl) and its layer, read as one bundle: files not in ``sealed`` (name to SHA-256) or changed since are an error."""
    files = landed(spark, root, "*.jsonl").select("document", "source_sha256").collect()
    found = {r.document.removesuffix(".jsonl"): r.source_sha256 for r in files}
    if found != dict(sealed):
        raise Stale(f"not as sealed: {sorted(set(found.items()) ^ set(sealed.items()))[:5]}")
    out = {n: read_jsonl(spark, f"{root}/{n}.jsonl", schema) for n, schema in schemas.items()}
    return out | {"layer": read_layer(spark, layer, schemas["layer"], manifest, version)} if "layer" in schemas else out


def external(spark: SparkSession, path: str, columns: Mapping[str, str], explode: str | None = None) -> DataFrame:
    """A foreign Parquet table under this engine's names (new name to old); ``explode``: a new name whose values are lists, one row each."""
    rows = spark.read.parquet(path).select(*[F.col(old).alias(new) for new, old in columns.items()])
    return rows.withColumn(explode, F.explode(explode)) if explode else rows


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in ``parts`` by ranges of a numeric key; the bounds divide the reads, they filter nothing."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def table_rows(text: Column) -> Column:
    """Cells of the rows of a Markdown table, without its rule and head: array of array of string."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))
    body = F.filter(lines, lambda x: ~x.rlike(r"^[\s|:-]+$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"\|", -1), lambda y: F.trim(y))
    return F.transform(F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))), cells)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(act, article) of an exclusion list (JSON, a list of acts with their articles); an act without articles is an error."""
    schema = T.StructType([T.StructField("act", T.StringType()), T.StructField("articles", T.ArrayType(T.StringType()))])
    rows = checked(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path), articles=F.size("articles") > 0)
    return rows.select("act", F.explode("articles").alias("article"))


def config_digest(config: Mapping[str, object], known: set[str]) -> str:
    """SHA-256 of a contract in canonical form; a name that isn't ``known`` or one that is missing is an error."""
    if set(config) != known:
        raise ValueError(f"not the contract's names: {sorted(set(config) ^ known)}")
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()
