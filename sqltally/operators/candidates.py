"""Run a table of SQL texts over Spark tables, without harm and within a time limit.

Each distinct text becomes one Spark plan. Texts whose plans mean the same are run once. Plans are
unioned in batches, one job per batch. Two kinds of run exist:

* ``run_candidates`` screens: per text only a row count and digests leave the job, whatever the
  size of the result. It records errors, time-outs and empty results.
* ``proofs`` runs those texts again whose large results agree in count and digest, and hashes every row; ordered
  results are written to the shared working folder for that, some at a time, and deleted.

``result_rows`` writes the normalised rows of chosen texts to the shared working folder.
"""

from __future__ import annotations

import functools
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import islice

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as X
from ..session import delete, kept, work_dir

# Read-only by grammar, yet able to reach past the data: they call any JVM method.
FORBIDDEN = re.compile(r"\b(reflect|java_method|try_reflect)\b`?\s*\(", re.IGNORECASE)
# Literals and comments, with and without backslash escapes: a call that either reading shows is refused.
_COMMENTS = r"--[^\n]*|(?s:/\*.*?\*/)"
LITERALS = [
    re.compile(rf"'[^']*'|\"[^\"]*\"|{_COMMENTS}"),
    re.compile(rf"'(?:[^'\\]|(?s:\\.))*'|\"(?:[^\"\\]|(?s:\\.))*\"|{_COMMENTS}"),
]

OUTCOME = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("error", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("bag", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("plan", T.StringType()),
    ]
)

QUERY_START = re.compile(X.QUERY_START)

# An ORDER BY that ends a text and names plain columns or places only: it changes no row and cannot fail.
_SORTED = r"(?:\d+|[a-z_]\w*(?:\.[a-z_]\w*)*)(?:\s+(?:asc|desc))?(?:\s+nulls\s+(?:first|last))?"
LAST_ORDER = re.compile(rf"\s+order\s+by\s+{_SORTED}(?:\s*,\s*{_SORTED})*\s*\Z", re.IGNORECASE | re.ASCII)

# Rows inside one partition of a result are numbered below this bit, partitions above it.
PARTITION_BITS = 33


#: Outcomes that are written together, about.
OUTCOMES_A_FILE = 8192
#: Rows of ordered results that lie in the working folder at once for their proof, unless one result has more.
PROVED_ROWS = 1 << 24
#: Seconds between two looks at a running candidate, at least; limits that it may wait for others before it is given up.
CLOCK, WAITS = 0.1, 10


class TimeLimitExceeded(Exception):
    pass


def text_key(db_id: Column, sql: Column) -> Column:
    """Key of a SQL text in its database; a missing text is an empty one."""
    return F.sha2(F.concat(F.coalesce(db_id, F.lit("")), F.lit("\n"), F.coalesce(sql, F.lit(""))), 256)


@dataclass
class Sandbox:
    """Databases that candidates may read, with the limits of a run.

    ``databases`` maps a ``db_id`` to its tables, each a parquet path or a DataFrame. Every
    database gets a session of its own, so its views cannot be seen from another one and the
    caller's session keeps its settings.
    """

    spark: SparkSession
    databases: Mapping[str, Mapping[str, str | DataFrame]]
    time_limit: float = fixed.TIME_LIMIT_SECONDS
    batch_size: int = 16
    parallel_batches: int = 16
    wave_size: int = 512
    # Rows per partition, and partitions, up to which a result is also hashed row by row.
    small_rows: int = 2048
    small_parts: int = 64
    _sessions: dict[str, SparkSession] = field(default_factory=dict)
    _shared: list[str] = field(default_factory=list)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def session(self, db_id: str) -> SparkSession:
        with self._lock:
            if db_id not in self._sessions:
                self._sessions[db_id] = self._open(db_id)
            return self._sessions[db_id]

    def _open(self, db_id: str) -> SparkSession:
        session = self.spark.newSession()
        for name in (
            "spark.sql.shuffle.partitions",
            "spark.sql.session.timeZone",
            "spark.sql.adaptive.enabled",
            "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.files.maxPartitionBytes",
            "spark.sql.codegen.wholeStage",
        ):
            session.conf.set(name, self.spark.conf.get(name))
        # A mistyped comparison is NULL in the scored dialect, not an error.
        session.conf.set("spark.sql.ansi.enabled", "false")
        # No reading of arbitrary files through a path used as a table name.
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        for name, table in self.databases[db_id].items():
            if isinstance(table, str):
                frame = session.read.parquet(table)
            else:
                # A DataFrame belongs to its session; a global view carries it into this one.
                shared = f"sandbox_{uuid.uuid4().hex}"
                table.createGlobalTempView(shared)
                self._shared.append(shared)
                frame = session.table(f"global_temp.{shared}")
            frame.createOrReplaceTempView(name)
        return session

    def close(self) -> None:
        """Forget the sessions and drop the views that carried DataFrames into them."""
        for name in self._shared:
            self.spark.catalog.dropGlobalTempView(name)
        self._shared.clear()
        self._sessions.clear()

    def body(self, db_id: str, sql: str) -> DataFrame | None:
        """The plan of a text without the ORDER BY that ends it, which gives the same rows; None if there is none to leave out."""
        if "--" in sql or "/*" in sql or (last := LAST_ORDER.search(sql)) is None:
            return None
        try:
            return self.plan(db_id, sql[: last.start()])
        except PySparkException:
            return None

    def plan(self, db_id: str, sql: str) -> DataFrame:
        """Analyse one candidate as a read-only query. Raises on anything that is not one.

        Inside the parentheses only a query or a relation parses, so DDL, DML and commands are parse errors; a bare table name or
        join does not begin as a query. The line break keeps a trailing comment from swallowing the closing parenthesis.
        """
        if not QUERY_START.search(sql):
            raise ValueError(fixed.NOT_A_QUERY)
        if any(FORBIDDEN.search(literals.sub(" ", sql)) for literals in LITERALS):
            raise PermissionError("function not allowed in a candidate")
        if db_id not in self.databases:
            raise LookupError(f"unknown database {db_id}")
        return self.session(db_id).sql(f"SELECT * FROM (\n{sql}\n)")


def normalised(df: DataFrame) -> tuple[DataFrame, str]:
    """A result with positional column names, and the comparable texts of its columns as a SQL list.

    One expression text instead of one call per column: with many small plans the calls between
    Python and the JVM would cost more than the analysis.
    """
    types = [f.dataType for f in df.schema.fields]
    names = [f"c{i}" for i in range(len(types))]
    return df.toDF(*names), ", ".join(X.normalise_sql(n, t) for n, t in zip(names, types))


def first_line(error: BaseException) -> str:
    lines = str(error).strip().splitlines()
    return lines[0] if lines else type(error).__name__


def _waiting(spark: SparkSession, group: str) -> bool:
    """Do the jobs of a group only wait for others: some run, and none of their tasks does?"""
    tracker = spark.sparkContext.statusTracker()
    jobs = [job for i in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(i)) and job.status == "RUNNING"]
    stages = [tracker.getStageInfo(s) for job in jobs for s in job.stageIds]
    return bool(jobs) and not any(stage is not None and stage.numActiveTasks for stage in stages)


@contextmanager
def _own_jobs(spark: SparkSession, group: str, pool: str) -> Iterator[None]:
    """Spark jobs of this thread run in a group and a scheduler pool of their own."""
    sc = spark.sparkContext
    names = {"spark.jobGroup.id": group, "spark.scheduler.pool": pool}
    before = {name: sc.getLocalProperty(name) for name in names}
    try:
        for name, value in names.items():
            sc.setLocalProperty(name, value)
        sc.addJobTag(group)
        yield
    finally:
        sc.removeJobTag(group)
        for name, value in before.items():
            sc.setLocalProperty(name, value)


def within(spark: SparkSession, seconds: float | None, action: Callable[[], object]):
    """Run an action in this thread; cancel its Spark jobs and raise once its time is up.

    Only time counts in which its own tasks run, or the driver works for it: what waits for the tasks of others is not late, but for
    ``WAITS`` limits at most. (A cancelled task ends where it next looks; inside the loops of a product that may be long.)
    Under ``spark.scheduler.mode=FAIR`` actions of several threads run side by side, each from a pool of its own.
    """
    if seconds is None:
        return action()
    sc = spark.sparkContext
    group = f"candidates-{uuid.uuid4().hex}"
    finished, expired = threading.Event(), threading.Event()

    def watch():
        used, start = 0.0, time.monotonic()
        last = start
        while not expired.is_set():
            # A look asks the driver about every job and stage of the group: a long limit needs fewer of them.
            if finished.wait(max(CLOCK, seconds / 100)):
                return
            now = time.monotonic()
            if not _waiting(spark, group):
                used += now - last
            last = now
            if used > seconds or now - start > WAITS * seconds:
                expired.set()
        # A job may start just after a cancellation: repeat until the action returns.
        while not finished.wait(CLOCK):
            sc.cancelJobsWithTag(group)

    with _own_jobs(spark, group, f"candidates-{threading.get_ident()}"):
        threading.Thread(target=watch, daemon=True).start()
        try:
            result = action()
        except Exception as error:
            if expired.is_set():
                raise TimeLimitExceeded from error
            raise
        finally:
            finished.set()
    if expired.is_set():
        raise TimeLimitExceeded
    return result


@contextmanager
def _no_analysis_log():
    """Rejected texts are results here: keep their stack traces out of the log while they are found."""
    log, drop = PySparkLogger.getLogger("SQLQueryContextLogger"), lambda record: False
    log.addFilter(drop)
    try:
        yield
    finally:
        log.removeFilter(drop)


def _waves(rows: Iterator, size: int):
    while wave := list(islice(rows, size)):
        yield wave


def _spread(spark: SparkSession, threads: int, work: Callable, items: list) -> list:
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def _aggregates(box: Sandbox) -> list[Column]:
    """``n``, ``digest`` and the bounded ``marks`` of rows ``pos, r``.

    ``digest`` is an order-free 64-bit sum over all rows, cheap at any size. The marks lead to SHA-256 over the
    sorted and over the ordered row hashes; only a result whose every row falls within the small limits has all of
    them, so the hashes held per result are bounded. The sandbox session adds without overflow checks, so the
    digest is a sum modulo 2**64.
    """
    at, part = f"pos & {(1 << PARTITION_BITS) - 1}L", f"shiftright(pos, {PARTITION_BITS})"
    mark = f"CASE WHEN {at} < {box.small_rows} AND {part} < {box.small_parts} THEN struct(pos, sha2(to_json(r), 256) AS s) END"
    return [
        F.expr("count(1) AS n"),
        F.expr("sum(xxhash64(r)) AS digest"),
        F.expr(f"sort_array(collect_list({mark})) AS marks"),
    ]


DIGESTS = [
    "n",
    "digest",
    "CASE WHEN size(marks) = n THEN sha2(array_join(array_sort(marks.s), ''), 256) END AS bag",
    "CASE WHEN size(marks) = n THEN sha2(array_join(marks.s, ''), 256) END AS seq",
]


def _screen(box: Sandbox, plans: list[tuple[str, DataFrame]]) -> dict[str, tuple]:
    """``n_rows, digest, bag, seq`` of each plan, by one shuffle for the whole batch; no row is written."""

    def hashed(i: int, plan: DataFrame) -> DataFrame:
        frame, values = normalised(plan)
        # The ids are made directly above the candidate's own sort, so they rise in its order.
        return frame.selectExpr(f"{i} AS i", "monotonically_increasing_id() AS pos", f"array({values}) AS r")

    rows = functools.reduce(DataFrame.union, [hashed(i, plan) for i, (_, plan) in enumerate(plans)])
    # Hashing inside the aggregates keeps it above the union: the code generated for it is the same in
    # every batch, and only the candidates' own parts are compiled anew.
    found = rows.groupBy("i").agg(*_aggregates(box)).selectExpr("i", *DIGESTS).collect()
    outcome = {key: (0, 0, None, None) for key, _ in plans}
    outcome.update({plans[r["i"]][0]: (r["n"], r["digest"], r["bag"], r["seq"]) for r in found})
    return outcome


def _store(box: Sandbox, folder: str, written: list[str], plans: list[tuple[str, DataFrame]]) -> dict[str, tuple]:
    """As ``_screen``, for results that are wanted: rows are written once and the figures read from them.

    Each attempt has a folder of its own, listed in ``written`` only when it is whole.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    functools.reduce(DataFrame.union, [_keyed(key, plan) for key, plan in plans]).write.parquet(path)
    rows = plans[0][1].sparkSession.read.schema(ROWS).parquet(path)
    placed = rows.selectExpr("key", f"shiftleft(part, {PARTITION_BITS}) | at AS pos", "r")
    found = placed.groupBy("key").agg(*_aggregates(box)).selectExpr("key", *DIGESTS).collect()
    outcome = {key: (0, 0, None, None) for key, _ in plans}
    outcome.update({r["key"]: (r["n"], r["digest"], r["bag"], r["seq"]) for r in found})
    written.append(path)
    return outcome


def _ran(result: tuple) -> tuple:
    return ("ok" if result[0] else "empty", None, *result)


def _failed(status: str, error: str) -> tuple:
    return (status, error, None, None, None, None)


def _same_plans(analysed: list[tuple[str, DataFrame, int]]) -> dict[str, str]:
    """Key of each plan to the key of the first plan with the same meaning.

    Catalyst compares the canonical plans, so letter case, table aliases and blanks do not matter.
    """
    first: dict[str, str] = {}
    by_hash: dict[int, list[tuple[str, DataFrame]]] = {}
    for key, plan, code in analysed:
        seen = by_hash.setdefault(code, [])
        twin = next((k for k, other in seen if plan.sameSemantics(other)), None)
        if twin is None:
            seen.append((key, plan))
        first[key] = twin or key
    return first


@dataclass
class Wave:
    """Texts that were analysed together: outcomes of those that do not run, and batches of plans for the others.

    ``first`` has the key of the first text with the same plan, ``ran`` that of the text whose rows count for it; ``placed`` are the
    texts that run in their order, so with a ``seq``.
    """

    rows: list
    outcomes: dict[str, tuple]
    first: dict[str, str]
    ran: dict[str, str]
    placed: set[str]
    batches: list[list[tuple[str, DataFrame]]]

    def told(self) -> list[tuple]:
        told = []
        for row in self.rows:
            twin = self.first.get(row["key"], row["key"])
            *figures, seq = self.outcomes[self.ran.get(twin, twin)]
            told.append((row["key"], row["db_id"], row["sql"], *figures, seq if twin in self.placed else None, twin))
        return told


def _analyse(box: Sandbox, rows: list, pool: ThreadPoolExecutor, in_order: bool) -> Wave:
    """Plans of texts; unless wanted ``in_order``, an ORDER BY that ends a text is left out of what runs, and equal rests run once."""

    def analyse(row):
        try:
            plan = box.plan(row["db_id"], row["sql"])
            normalised(plan)
            body = None if in_order else box.body(row["db_id"], row["sql"])
            loose = (plan, plan.semanticHash()) if body is None else (body, body.semanticHash())
            return row, (plan, plan.semanticHash(), body is None, *loose), None
        except (PySparkException, PermissionError, LookupError, ValueError) as error:
            return row, None, first_line(error)

    outcomes: dict[str, tuple] = {}
    by_db: dict[str, list] = {}
    for row, found, error in pool.map(inheritable_thread_target(box.spark)(analyse), rows):
        if found is None:
            outcomes[row["key"]] = _failed("error", error)
        else:
            by_db.setdefault(row["db_id"], []).append((row["key"], *found))
    first, ran, placed, batches = {}, {}, set(), []
    for analysed in by_db.values():
        first |= _same_plans([(key, plan, code) for key, plan, code, *_ in analysed])
        mine = [(key, rest, code) for key, _, _, _, rest, code in analysed if first[key] == key]
        ran |= _same_plans(mine)
        placed |= {key for key, _, _, whole, *_ in analysed if whole}
        plans = [(key, rest) for key, rest, _ in mine if ran[key] == key]
        batches += [plans[i : i + box.batch_size] for i in range(0, len(plans), box.batch_size)]
    return Wave(rows, outcomes, first, ran, placed, batches)


def _ahead(items: Iterator, made: Callable, spark: SparkSession) -> Iterator:
    """``made(item)`` for all items in their order, one item ahead of the caller."""
    with ThreadPoolExecutor(max_workers=1) as one:
        step = inheritable_thread_target(spark)(lambda: made(item) if (item := next(items, None)) is not None else None)
        coming = one.submit(step)
        while (now := coming.result()) is not None:
            coming = one.submit(step)
            yield now


def _execute(box: Sandbox, wave: Wave, run: Callable[[list], dict[str, tuple]]) -> None:
    """Run a wave's batches side by side and put the outcomes into it.

    A batch that ends within the limit of one candidate proves that each member does. One that fails is run again in halves. The
    members of one that is late run again each for itself, so late texts of many batches use up their time together.
    """

    def attempt(batch):
        try:
            return {key: _ran(result) for key, result in within(box.spark, box.time_limit, lambda: run(batch)).items()}, []
        except TimeLimitExceeded:
            if len(batch) == 1:
                return {batch[0][0]: _failed("timeout", fixed.TIMEOUT)}, []
            return {}, [[member] for member in batch]
        except Exception as error:  # one member failed, and nothing tells which
            if len(batch) == 1:
                return {batch[0][0]: _failed("error", first_line(error))}, []
            half = len(batch) // 2
            return {}, [batch[:half], batch[half:]]

    with ThreadPoolExecutor(max_workers=box.parallel_batches) as pool:
        waiting = {pool.submit(inheritable_thread_target(box.spark)(attempt), batch) for batch in wave.batches}
        while waiting:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            for found, again in (f.result() for f in done):
                wave.outcomes.update(found)
                waiting |= {pool.submit(inheritable_thread_target(box.spark)(attempt), batch) for batch in again}


def distinct_texts(texts: DataFrame) -> DataFrame:
    """Distinct ``(db_id, sql)`` with their key; repeated texts collapse before the shuffle."""
    return (
        texts.select("db_id", F.coalesce("sql", F.lit("")).alias("sql"))
        .distinct()
        .withColumn("key", text_key(F.col("db_id"), F.col("sql")))
    )


def refusal(sql: Column) -> Column:
    """Error of a text that is no query by its beginning; null for others."""
    return F.when(X.is_blank(sql), fixed.EMPTY_SQL).when(~X.begins_as_query(sql), fixed.NOT_A_QUERY)


def run_candidates(box: Sandbox, texts: DataFrame) -> DataFrame:
    """Outcomes of the distinct texts of ``texts(db_id, sql)``, each run once, see ``_run``."""
    return _run(box, texts, functools.partial(_screen, box), False)


def run_and_keep(box: Sandbox, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``run_candidates``, with the rows ``key, part, at, r`` of the texts that were run; one run serves both."""
    folder, written = work_dir(box.spark, "rows"), []
    outcomes = _run(box, texts, functools.partial(_store, box, folder, written), True)
    read = box.spark.read.schema(ROWS)
    return outcomes, read.parquet(*written) if written else box.spark.createDataFrame([], ROWS)


def _run(box: Sandbox, texts: DataFrame, run: Callable[[list], dict[str, tuple]], in_order: bool) -> DataFrame:
    """Run each distinct text of ``texts(db_id, sql)`` once.

    Returns ``key, db_id, sql, status, error, n_rows, digest, bag, seq, plan`` with status ``ok``,
    ``empty``, ``error`` or ``timeout``; ``plan`` is the key of the first text with the same meaning. Unless ``in_order``, a text
    that ends with a plain ORDER BY runs without it and has no ``seq``: most such results differ in their rows already. Texts
    that do not begin as a query does, prose above all, are refused where they lie. The others
    reach the driver in waves, of which one is analysed while the one before it runs; results never do. Outcomes are kept in
    the shared working folder, some thousands in a file, so a lost executor repeats no candidate.
    """
    spark = box.spark
    schema = T.StructType(
        OUTCOME.fields[:1]
        + [T.StructField("db_id", T.StringType()), T.StructField("sql", T.StringType())]
        + OUTCOME.fields[1:]
    )
    path, told, written = work_dir(spark, "outcomes"), [], False
    judged = kept(distinct_texts(texts).withColumn("error", refusal(F.col("sql"))), "judged")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in OUTCOME.fields[3:7]]
    refused = judged.where("error IS NOT NULL").select("key", "db_id", "sql", F.lit("error").alias("status"), "error", *nothing, F.col("key").alias("plan"))
    asked = judged.where("error IS NULL").select("db_id", "sql", "key")
    waves = _waves(asked.toLocalIterator(prefetchPartitions=True), box.wave_size)
    with _no_analysis_log(), ThreadPoolExecutor(max_workers=box.parallel_batches) as pool:
        for wave in _ahead(waves, lambda rows: _analyse(box, rows, pool, in_order), spark):
            _execute(box, wave, run)
            told += wave.told()
            if len(told) >= OUTCOMES_A_FILE:
                spark.createDataFrame(told, schema).coalesce(1).write.mode("append").parquet(path)
                told, written = [], True
    if not written:
        return (kept(spark.createDataFrame(told, schema).coalesce(1), "outcomes") if told else spark.createDataFrame([], schema)).unionByName(refused)
    if told:
        spark.createDataFrame(told, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).unionByName(refused)


ROWS = "key string, part bigint, at bigint, r array<string>"


def _keyed(key: str, plan: DataFrame) -> DataFrame:
    """Comparable rows of a plan; ``(part, at)`` rises in the order in which they come out."""
    frame, values = normalised(plan)
    # The ids are made directly above the candidate's own sort, so they rise in its order.
    return frame.selectExpr(f"'{key}' AS key", "monotonically_increasing_id() AS pos", f"array({values}) AS r").selectExpr(
        "key", f"shiftright(pos, {PARTITION_BITS}) AS part", f"pos & {(1 << PARTITION_BITS) - 1}L AS at", "r"
    )


def result_rows(box: Sandbox, texts: DataFrame) -> DataFrame:
    """Rows of texts known to run, as ``key, part, at, r``, kept in the working folder.

    ``texts`` holds ``key, db_id, sql``; it reaches the driver in waves.
    """
    spark = box.spark
    path = work_dir(spark, "rows")
    written = []

    def write(job):
        number, members = job
        plans = [_keyed(row["key"], box.plan(row["db_id"], row["sql"])) for row in members]
        folder = f"{path}/batch={number}"
        functools.reduce(DataFrame.union, plans).write.parquet(folder)
        return folder

    for wave in _waves(texts.select("key", "db_id", "sql").toLocalIterator(), box.wave_size):
        by_db: dict[str, list] = {}
        for row in wave:
            by_db.setdefault(row["db_id"], []).append(row)
        batches = [
            rows[i : i + box.batch_size] for rows in by_db.values() for i in range(0, len(rows), box.batch_size)
        ]
        jobs = list(enumerate(batches, start=len(written)))
        written += _spread(spark, box.parallel_batches, write, jobs)
    if not written:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(path).drop("batch")


def dense_positions(rows: DataFrame) -> DataFrame:
    """Add ``pos``, dense from 0 in result order.

    Positions inside a part are dense already; only the sizes of the parts are scanned in order,
    so a result of any size is numbered without bringing it together. The offsets are written: their
    size is known to be small, and the rows stay where they are.
    """
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("key", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return rows.join(kept(offsets, "offsets"), ["key", "part"]).withColumn("pos", F.col("at") + F.col("offset")).drop("offset")


PROOF = "ordered boolean, key string, proof string"


def _proof(salt: str, pos: str) -> list[Column]:
    """The number of rows ``pos, r`` and sums over the salted SHA-256 of each, in four words of 64 bits.

    Equal rows give equal sums in any order, and an order counts where ``pos`` tells it. The salt is drawn for one comparison, so no
    result can be made to fit. Decimals add without a wrap, in any session.
    """
    mark = f"sha2(concat('{salt}', to_json(struct({pos} AS pos, r))), 256)"
    words = [F.expr(f"sum(CAST(xxhash64({i}, {mark}) AS DECIMAL(20, 0)))").cast("string") for i in range(4)]
    return [F.concat_ws(" ", F.count(F.lit(1)).cast("string"), *words).alias("proof")]


def row_proofs(rows: DataFrame, salt: str) -> DataFrame:
    """``ordered, key, proof`` from rows ``ordered, key, part, at, r``; a result may be asked for with its order and without it."""
    places = dense_positions(rows.where("ordered")).unionByName(rows.where("NOT ordered").withColumn("pos", F.lit(-1).cast("bigint")))
    return places.groupBy("ordered", "key").agg(*_proof(salt, "pos")).select("ordered", "key", "proof")


def proofs(box: Sandbox, texts: DataFrame, salt: str) -> DataFrame:
    """``ordered, key, proof`` of texts ``ordered, key, db_id, sql, n_rows`` that are known to run, from every row.

    Where no order counts, the rows are hashed as they come and none is written. Positions of an ordered result are known
    when it is whole: such results are written, ``PROVED_ROWS`` at once or one that is larger, hashed and deleted.
    """
    spark = box.spark
    folder, path, written = work_dir(spark, "proof-rows"), work_dir(spark, "proofs"), False

    def plans(members):
        return [(row["key"], box.plan(row["db_id"], row["sql"])) for row in members]

    def loose(members):
        def one(key, plan):
            frame, values = normalised(plan)
            return frame.selectExpr(f"array({values}) AS r").agg(*_proof(salt, "-1L")).selectExpr("false AS ordered", f"'{key}' AS key", "proof")

        return functools.reduce(DataFrame.union, [one(*p) for p in plans(members)]).collect()

    def placed(members):
        rows = f"{folder}/{uuid.uuid4().hex}"
        functools.reduce(DataFrame.union, [_keyed(*p) for p in plans(members)]).write.parquet(rows)
        found = row_proofs(spark.read.schema(ROWS).parquet(rows).withColumn("ordered", F.lit(True)), salt).collect()
        delete(spark, rows)
        return found

    def batches(rows):
        by_db: dict[str, list] = {}
        for row in rows:
            by_db.setdefault(row["db_id"], []).append(row)
        return [own[i : i + box.batch_size] for own in by_db.values() for i in range(0, len(own), box.batch_size)]

    def rounds(rows):
        some, size = [], 0
        for row in rows:
            if some and size + row["n_rows"] > PROVED_ROWS:
                yield some
                some, size = [], 0
            some.append(row)
            size += row["n_rows"]
        if some:
            yield some

    for wave in _waves(texts.select("ordered", "key", "db_id", "sql", "n_rows").toLocalIterator(), box.wave_size):
        told = _spread(spark, box.parallel_batches, loose, batches([row for row in wave if not row["ordered"]]))
        for some in rounds([row for row in wave if row["ordered"]]):
            told += _spread(spark, box.parallel_batches, placed, batches(some))
        spark.createDataFrame([tuple(row) for rows in told for row in rows], PROOF).coalesce(1).write.mode("append").parquet(path)
        written = True
    return spark.read.schema(PROOF).parquet(path) if written else spark.createDataFrame([], PROOF)


def outcome_table(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status of each candidate of ``candidates(cid, db_id, sql)``."""
    keyed = candidates.withColumn("key", text_key(F.col("db_id"), F.col("sql")))
    return keyed.join(outcomes.select("key", "status", "error", "n_rows", "digest"), "key", "left")
