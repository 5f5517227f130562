"""Sampling, pooling, adjudication, constraints, citations and event logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stratiform.functions.text import hash_mod
from stratiform.scratch import Scratch


def hash_order(df: DataFrame, key: str, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)


def stratified_round_robin(df: DataFrame, group: str, key: str, salt: str, n: int) -> DataFrame:
    """n rows, one of each group in turn, inside a group by hash."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(df, key, salt), key))
    return df.withColumn("turn", turn).orderBy("turn", hash_order(df, key, salt), key).limit(n)


def split(df: DataFrame, key: str, salt: str, percent: int = 15) -> DataFrame:
    return df.withColumn("validation", hash_mod(F.col(key), salt, 100) < percent)


def pool(runs: list[tuple[str, DataFrame]], depth: int) -> DataFrame:
    """(query_id, doc_id, contributors, best): union of the contributors' first documents."""
    every = None
    for name, run in runs:
        part = run.filter(F.col("rank") <= depth).select("query_id", "doc_id", "rank", F.lit(name).alias("contributor"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("contributor")), ",").alias("contributors"), F.min("rank").alias("best"))


def pool_of_needs(runs: DataFrame, queries: DataFrame, depths: dict[str, int], anchors: DataFrame, name: str = "anchor") -> DataFrame:
    """(need_id, doc_id, sources): over a need's queries (query_id, need_id) what each contributor of ``runs`` (contributor, query_id, doc_id, rank) ranks within its own depth, and the need's ``anchors`` (need_id, doc_id).

    ``sources``: (contributor, query_id, rank), in order; an anchor has no query and rank 0. Contributors without a depth give nothing.
    """
    depth = F.coalesce(*[F.when(F.col("contributor") == c, d) for c, d in depths.items()]) if depths else F.lit(None).cast("int")
    kind = queries.schema["query_id"].dataType
    found = runs.filter(F.col("rank") <= depth).join(queries.select("query_id", "need_id"), "query_id").select("need_id", "doc_id", "contributor", "query_id", F.col("rank").cast("int").alias("rank"))
    every = found.unionByName(anchors.select("need_id", "doc_id", F.lit(name).alias("contributor"), F.lit(None).cast(kind).alias("query_id"), F.lit(0).alias("rank")))
    return every.groupBy("need_id", "doc_id").agg(F.array_sort(F.collect_set(F.struct("contributor", "query_id", "rank"))).alias("sources"))


def decisive(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Documents in exactly one of two top-k lists."""
    x, y = (r.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias(n)) for r, n in ((a, "x"), (b, "y")))
    return x.join(y, ["query_id", "doc_id"], "full_outer").filter("x is null or y is null").select("query_id", "doc_id", F.when(F.col("x").isNull(), "second").otherwise("first").alias("side"))


def adjudicated(first: DataFrame, second: DataFrame, third: DataFrame, keys: list[str]) -> DataFrame:
    """Final grade of two judges, a third where they differ: (keys, grade, outcome)."""
    j = first.select(*keys, F.col("grade").alias("g1")).join(second.select(*keys, F.col("grade").alias("g2")), keys, "left").join(third.select(*keys, F.col("grade").alias("g3")), keys, "left")
    agree = F.col("g2").isNull() | (F.col("g1") == F.col("g2"))
    grade = F.when(agree, F.col("g1")).otherwise(F.col("g3"))
    outcome = F.when(F.col("g2").isNull(), "single").when(agree, "agreed").when(F.col("g3").isNull(), "open").otherwise("decided")
    return j.select(*keys, grade.alias("grade"), outcome.alias("outcome"))


def duplicate_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), "n")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    missing = df.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return missing.groupBy(key).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), "n")


def chain(events: DataFrame, key: str, order: str, payload: list[str], seed: str = "") -> DataFrame:
    """Per-log digests (columns ``previous`` and ``own``): each covers the one before it and its own payload, so a
    changed row breaks every later one. A log is read in order, a row at a time; of a task's logs one digest is held."""
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload])
    rows = events.withColumn("payload_", text)
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, last = object(), seed
        for batch in batches:
            previous, own = [], []
            for k, said in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != log:
                    log, last = k, seed
                previous.append(last)
                last = hashlib.sha256(f"{last}\t{said}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(previous, pa.string()), pa.array(own, pa.string())], [*batch.schema.names[:-1], "previous", "own"])

    fields = [*rows.schema.fields[:-1], StructField("previous", StringType()), StructField("own", StringType())]
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, StructType(fields))


def broken_links(chained: DataFrame, key: str, order: str, payload: list[str], seed: str = "") -> DataFrame:
    """Rows whose digests aren't those of the chain worked out again, with the ones expected."""
    again = chain(chained.drop("previous", "own"), key, order, payload, seed).select(key, order, F.col("own").alias("expected"))
    return chained.join(again, [key, order]).filter(~F.col("own").eqNullSafe(F.col("expected")))


def folded(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Last state per key, pre-aggregated: no window, no order inside a task."""
    return events.groupBy(key).agg(F.max_by(status, order).alias("state"), F.count("*").alias("events"))


def divergent(events: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys recorded with more than one payload."""
    return events.groupBy(key).agg(F.countDistinct(payload).alias("payloads")).filter("payloads > 1")


def waits(events: DataFrame, key: str, at: str, gap_s: int, most: int, window_s: int) -> DataFrame:
    """Events that break a rate limit: sooner than ``gap_s`` after the last, or more than ``most`` in ``window_s``."""
    t = F.unix_timestamp(at)
    w = Window.partitionBy(key).orderBy(t)
    rows = events.withColumn("since", t - F.lag(t).over(w)).withColumn("recent", F.count("*").over(w.rangeBetween(-window_s, 0)))
    return rows.filter((F.col("since") < gap_s) | (F.col("recent") > most))


def episodes(events: DataFrame, key: str, at: str, gap_s: int, base_s: int, cap_s: int) -> DataFrame:
    """Sessions by gaps; the wait after the n-th event of a session doubles up to a cap."""
    t = F.unix_timestamp(at)
    w = Window.partitionBy(key).orderBy(at, "event_id")
    new = (F.coalesce(t - F.lag(t).over(w), F.lit(gap_s + 1)) > gap_s).cast("int")
    rows = events.withColumn("new", new).withColumn("episode", F.sum("new").over(w))
    return rows.groupBy(key, "episode").agg(F.count("*").alias("n")).withColumn("wait_s", F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), F.col("n") - 1), F.lit(float(cap_s))))


def greedy_kept(items: DataFrame, similar: DataFrame, key: str, order: str, rounds: int = 1000) -> DataFrame:
    """Items kept in priority order: an item goes iff an earlier similar one stays. (key, kept)

    ``similar`` holds undirected pairs (a, b). In each round every open item all of whose earlier neighbours are settled
    is settled, so rounds are the longest chain of neighbours in falling priority; each is a join, cut by a table in the
    shared folder. More than ``rounds`` of them are an error.
    """
    rank = items.select(key, order)
    ends = similar.join(rank.toDF("a", "ra"), "a").join(rank.toDF("b", "rb"), "b")
    earlier = ends.select(
        F.when(F.col("ra") > F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("late"),
        F.when(F.col("ra") > F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("early"),
    ).distinct()
    scratch = Scratch(items.sparkSession, "greedy")
    earlier, state = scratch.keep(earlier), scratch.keep(rank.select(key, F.lit(None).cast("boolean").alias("kept")))
    for _ in range(rounds):
        open_ = state.filter("kept is null")
        seen = earlier.join(state.select(F.col(key).alias("early"), "kept"), "early")
        facts = seen.groupBy(F.col("late").alias(key)).agg(F.max(F.coalesce("kept", F.lit(False)).cast("int")).alias("any"), F.sum(F.col("kept").isNull().cast("int")).alias("open"))
        decided = F.when(F.col("any") == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True)
        new = scratch.keep(state.filter("kept is not null").unionByName(open_.select(key).join(facts, key, "left").select(key, decided.alias("kept"))))
        scratch.drop(state)
        state = new
        if state.filter("kept is null").isEmpty():
            return state
    raise RuntimeError(f"items are still open after {rounds} rounds")


def unique_contribution(pooled: DataFrame) -> DataFrame:
    """Per contributor the pooled documents and those that no other one found; of (query_id, doc_id, contributors)."""
    names = F.split("contributors", ",")
    each = pooled.select(F.explode(names).alias("contributor"), (F.size(names) == 1).cast("int").alias("alone"))
    return each.groupBy("contributor").agg(F.count("*").alias("found"), F.sum("alone").alias("alone"))


def resumed(jobs: DataFrame, records: DataFrame, key: str, request: str) -> tuple[DataFrame, DataFrame]:
    """(open, replayed) of a run that goes on: recorded answers are taken as they are, only jobs without one are open.

    jobs: (key, request, ...), records: (key, request, answer). A record of the same key with another request is an
    error when the rows are read: answers are never given to a question they weren't asked.
    """
    known = records.select(key, F.col(request).alias("recorded_"), "answer")
    both = jobs.join(known, key, "left")
    same = F.col("recorded_").eqNullSafe(F.col(request))
    told = F.when(same, F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("recorded for another request: "), F.col(key).cast("string"))).cast(records.schema["answer"].dataType))
    return both.filter("recorded_ is null").select(*jobs.columns), both.filter("recorded_ is not null").withColumn("answer", told).select(*jobs.columns, "answer")


def owed(first: DataFrame, second: DataFrame, decisive: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason): nodes a second judge must see and hasn't: graded 1 or more, ambiguous, or decisive."""
    marks = first.join(decisive.select(*keys).distinct().withColumn("d_", F.lit(True)), keys, "left")
    reason = F.when(F.col("grade") >= 1, "graded").when(F.coalesce("ambiguous", F.lit(False)), "ambiguous").when(F.col("d_"), "decisive")
    return marks.withColumn("reason", reason).filter("reason is not null").join(second.select(*keys).distinct(), keys, "left_anti").select(*keys, "reason")


def disputes(first: DataFrame, second: DataFrame, third: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, g1, g2): nodes two judges differ on that a third hasn't decided."""
    both = first.select(*keys, F.col("grade").alias("g1")).join(second.select(*keys, F.col("grade").alias("g2")), keys)
    return both.filter("g1 <> g2").join(third.select(*keys).distinct(), keys, "left_anti")


def assembled(judgments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, judges, grade, outcome) of three judges' judgments (keys, judge, grade): all agree, two of three, or the middle one of three that differ."""
    each = judgments.groupBy(*keys).agg(F.array_sort(F.collect_list("grade")).alias("g"), F.count("*").alias("judges"))
    middle = F.get(F.col("g"), F.floor((F.size("g") - 1) / 2).cast("int"))
    kinds = F.size(F.array_distinct("g"))
    outcome = F.when(F.col("judges") < 3, "incomplete").when(kinds == 1, "unanimous").when(kinds == 2, "majority").otherwise("middle")
    return each.select(*keys, "judges", F.when(F.col("judges") >= 3, middle).alias("grade"), outcome.alias("outcome"))


def contamination(statements: DataFrame, references: DataFrame, key: str, text: str, size: int = 8) -> DataFrame:
    """(key, runs, shared): how many of a statement's runs of ``size`` words stand in any reference, for those that share one.

    Runs are distinct hashes, made of the words of a text that are taken once; references' runs are distinct.
    """
    from stratiform.functions.legal import runs
    from stratiform.functions.text import ascii_words

    # the words are bound to a name: an expression inside a function of each place would be worked out again for each
    hashes = lambda c: F.flatten(F.transform(F.array(ascii_words(c)), lambda w: F.array_distinct(F.transform(runs(w, size), lambda r: F.xxhash64(r)))))
    mine = statements.select(key, F.explode(hashes(F.col(text))).alias("run"))
    theirs = references.select(F.explode(hashes(F.col(text))).alias("run")).distinct()
    hit = mine.join(theirs.withColumn("hit_", F.lit(1)), "run", "left")
    return hit.groupBy(key).agg(F.count("*").alias("runs"), F.count("hit_").alias("shared")).filter("shared > 0")


def review_summary(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row of two judges' agreement (keys, grade): nodes both saw, equal grades, equal relevance, Cohen's kappa of the relevance."""
    both = first.select(*keys, F.col("grade").alias("a")).join(second.select(*keys, F.col("grade").alias("b")), keys)
    x, y = (F.col("a") >= 2).cast("double"), (F.col("b") >= 2).cast("double")
    s = both.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("same"), F.avg((x == y).cast("double")).alias("agree"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    chance = F.col("x") * F.col("y") + (1 - F.col("x")) * (1 - F.col("y"))
    return s.select("n", F.round("same", 6).alias("same"), F.round("agree", 6).alias("agree"), F.when(chance < 1, F.round((F.col("agree") - chance) / (1 - chance), 6)).alias("kappa"))
