"""Event logs and jobs: latest state, ranges and pages, rates, gaps and archives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.running import Rounds, cut, parts_of, running_last, running_sum


def latest_by(log: DataFrame, key: str, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """The values of each key's last row. Aggregated before the shuffle, so a hot key costs a row per task."""
    last = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(v, last).alias(v) for v in values])


def append_rules(log: DataFrame, key: str, kind: str, order: tuple[str, ...], repeated: str, ignored: Column) -> DataFrame:
    """The log without ignored rows, and with rows of kind ``repeated`` only where the key was not logged before."""
    first = log.where(~ignored).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    joined = log.where(~ignored).join(first, key)
    return joined.where((F.col(kind) != repeated) | (F.struct(*order) == F.col("__first"))).drop("__first")


def log_page(log: DataFrame, order: tuple[str, ...], where: Column, descending: bool, offset: int, limit: int) -> DataFrame:
    """One page of the rows that fit, in order."""
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    return log.where(where).orderBy(*keys).offset(offset).limit(limit)


def default_range(at: str, now: Column, descending: bool, since: Column | None = None, until: Column | None = None) -> Column:
    """Whether a row's time lies in a range, both ends included. Without any bound a descending page ends now, and an
    ascending one begins now."""
    if since is None and until is None:
        since, until = (None, now) if descending else (now, None)
    fits = F.lit(True) if since is None else F.col(at) >= since
    return fits if until is None else fits & (F.col(at) <= until)


def trailing_count(log: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """The rows with ``n_recent``: rows of the key in the ``seconds`` up to the row, itself included.

    Time is cut into slices of that length. A slice counts its own rows and those lent by the slice before, so a
    frequent key is spread over its slices. Rows of a null time count those of a null time.
    """
    length = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    own = log.withColumn("__at", micros).withColumn("__slice", F.floor(F.col("__at") / length)).withColumn("__lent", F.lit(False))
    lent = own.where("__at is not null").withColumn("__slice", F.col("__slice") + 1).withColumn("__lent", F.lit(True))
    span = Window.partitionBy(key, "__slice").orderBy("__at").rangeBetween(-length, 0)
    return own.unionByName(lent).withColumn("n_recent", F.count("*").over(span)).where("not __lent").drop("__at", "__slice", "__lent")


def durations(log: DataFrame, key: str, order: tuple[str, ...], at: str) -> DataFrame:
    """The rows with ``seconds`` to the key's next row, to a tenth; null for its last. The order is unique in a key.

    Rows are numbered and looked up backwards over ranges, so a frequent key is spread over tasks.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    numbered = running_sum(log, (key,), order, F.lit(-1).cast("long"), "__back")
    found = running_last(numbered, (key,), ("__back",), {"__next": F.struct(micros.alias("micros"))})
    return found.select(*log.columns, F.round((F.col("__next.micros") - micros) / 1e6, 1).alias("seconds"))


def archive(log: DataFrame, key: str, order: tuple[str, ...], keep: int = 100) -> DataFrame:
    """The last ``keep`` rows of each key; Spark ranks inside tasks first, so a hot key is cut before its shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("__rank", rank).where(F.col("__rank") <= keep).drop("__rank")


def without_repeats(calls: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], at: str, gap_seconds: int) -> DataFrame:
    """Calls whose key was not called in the ``gap_seconds`` before. The order is unique in a key; the call before is a last
    value over ranges, so a frequent key is spread over tasks."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    found = running_last(calls, keys, order, {"__before": F.struct(micros.alias("micros"))})
    since = micros - F.col("__before.micros")
    return found.where(since.isNull() | (since > gap_seconds * 1_000_000)).select(*calls.columns)


def all_pass(lines: DataFrame, key: str, passes: Column) -> DataFrame:
    """Keys all of whose rows pass, with the number of rows."""
    return lines.groupBy(key).agg(F.count("*").alias("n_lines"), F.bool_and(passes).alias("__all")).where("__all").drop("__all")


def strongest_status(changes: DataFrame, key: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """key, status (the first of ``order`` that any row has) and n_rows."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    best = F.min(F.when(place > 0, place))
    return changes.groupBy(key).agg(F.get(F.array(*[F.lit(s) for s in order]), (best - 1).cast("int")).alias("status"), F.count("*").alias("n_rows"))


def job_schedule(calls: DataFrame, drive: str, order: str) -> DataFrame:
    """drive, order and outcome of the calls that schedule a job, under the rules that hold between jobs of one drive.

    ``calls`` have drive, order (unique in a drive), op (schedule, start or finish), type and payload. A job is active
    from its scheduling to its finish. A scheduled ``sync_all`` is dropped while one is active, else all waiting jobs
    of the drive make way for it; a ``sync`` is dropped while a ``sync_all`` or a ``sync`` of its payload is active; a
    ``run_action`` is never dropped; of other types one job is active at a time. Outcomes: ``dropped``; ``replaced`` by
    a later sync_all while waiting; ``started`` or ``finished`` (without a start), what came next; ``waiting``.

    The state of a slot (a payload of sync or run_action, another type as a whole) before a call follows from the
    last start or finish in the slot, the last call in it, and how many times the drive's waiting jobs had made way by
    then. These are last values and sums over ranges of (drive, order), so no task folds the history of a drive.
    """
    whole = F.col("type") == "sync_all"
    rows = running_last(calls.select(drive, order, "op", "type", "payload"), (drive,), (order,), {"__all": F.when(whole, F.col("op"))})
    free = F.col("__all").isNull() | (F.col("__all") == "finish")
    scheduled = F.col("op") == "schedule"
    rows = running_sum(rows.withColumn("__taken", whole & scheduled & free), (drive,), (order,), F.col("__taken").cast("long"), "__flush")
    blocked = scheduled & F.when(whole, ~F.col("__taken")).otherwise((F.col("type") == "sync") & ~free)
    rows = rows.withColumn("__blocked", blocked).withColumn("__slot", F.when(F.col("type").isin("sync", "run_action"), F.coalesce("payload", F.lit(""))))
    slot, move = (drive, "type", "__slot"), F.when(~scheduled, F.struct("op", F.col("__flush").alias("flush")))
    live = running_last(rows.where("not __blocked"), slot, (order,), {"__moved": move, "__before": F.struct("op", F.col("__flush").alias("flush"))})
    running = F.coalesce(F.col("__moved.op") == "start", F.lit(False))
    waits = F.coalesce((F.col("__before.op") == "schedule") & (F.col("__before.flush") == F.col("__flush")), F.lit(False))
    live = live.withColumn("__kept", ~scheduled | whole | (F.col("type") == "run_action") | ~(running | waits))
    back = live.withColumn("__back", -F.col(order))
    ahead = running_last(back, slot, ("__back",), {"__next": move}).where(scheduled)
    last = rows.groupBy(drive).agg(F.max("__flush").alias("__last_flush"))
    in_time = whole | (F.col("__next.flush") == F.col("__flush"))
    then = F.when(F.col("__next").isNotNull() & in_time, F.when(F.col("__next.op") == "start", "started").otherwise("finished"))
    fate = F.coalesce(then, F.when(~whole & (F.col("__last_flush") > F.col("__flush")), F.lit("replaced")), F.lit("waiting"))
    judged = ahead.join(last, drive).select(drive, order, F.when(F.col("__kept"), fate).otherwise("dropped").alias("outcome"))
    return judged.unionByName(rows.where("__blocked").select(drive, order, F.lit("dropped").alias("outcome")))


def active_dedupe(calls: DataFrame, drive: str, kind: str, payload: str, order: str, ended: str) -> DataFrame:
    """Calls that schedule a job: of calls of one drive, kind and payload, those made when no scheduled one is active.

    A call is active from its order to its ``ended`` (null: for ever); a dropped call blocks nothing. Each call points to
    the one that would be taken after it, the first at or after its end; those that the first call of its group leads to
    are taken. The pointers are last values over ranges, going back in time, and the way along them is found by pointer
    doubling, so no task folds the calls of a group.
    """
    group = (drive, kind, payload)
    rounds = Rounds(calls.sparkSession, "active")
    rows = cut(calls.select(*group, F.col(order).alias("__at"), F.col(ended).alias("__end")).withColumn("__row", F.monotonically_increasing_id()))
    placed = rounds.put(running_sum(rows, group, ("__at", "__end", "__row"), F.lit(1).cast("long"), "__n").drop("__row"))
    events_ = placed.select(*group, F.col("__at").alias("__t"), F.lit(1).alias("__call"), F.col("__n").alias("__id")).unionByName(placed.where("__end is not null").select(*group, F.col("__end").alias("__t"), F.lit(0).alias("__call"), F.col("__n").alias("__id")))
    timed = running_sum(events_, group, ("__t", "__call", "__id"), F.lit(-1).cast("long"), "__back")
    ahead = running_last(timed, group, ("__back",), {"__first": F.when(F.col("__call") == 1, F.col("__id"))}).where("__call = 0")
    jumps = rounds.put(ahead.select(*group, F.col("__id").alias("__n"), F.greatest("__first", F.col("__id") + 1).alias("__to")).where("__first is not null"))
    taken = rounds.put(placed.where("__n = 1").select(*group, "__n"))
    parts = parts_of(placed)
    # groups are structs, which join by plain equality, nulls included; so both sides can be dealt before the join
    keyed = lambda df, n: df.select(F.struct(*group).alias("__group"), F.col(n).alias("__n"), *[c for c in df.columns if c not in (*group, n)]).repartition(parts, "__group", "__n")
    out = [F.col(f"__group.{g}") for g in group]
    for _ in range(math.ceil(math.log2(placed.count() + 1)) + 1):
        if jumps.isEmpty():
            break
        led = keyed(taken, "__n").join(keyed(jumps, "__n"), ["__group", "__n"]).select(*out, F.col("__to").alias("__n"))
        more = rounds.put(taken.unionByName(led))
        behind = keyed(jumps.withColumnRenamed("__n", "__from"), "__to")
        twice = rounds.put(behind.join(keyed(jumps, "__n"), ["__group", "__n"]).select(*out, F.col("__from").alias("__n"), "__to"))
        rounds.drop(taken, jumps)
        taken, jumps = more, twice
    return keyed(placed, "__n").join(keyed(taken, "__n"), ["__group", "__n"], "left_semi").select(*out, F.col("__at").alias(order))


def last_finished(jobs: DataFrame, key: str, order: str, state: str, started: str, finished: str) -> DataFrame:
    """Per key the first done or failed job in stored order: its state and its seconds, to a tenth."""
    done = jobs.where(F.col(state).isin("done", "failed"))
    return done.groupBy(key).agg(F.min_by(state, order).alias("state"), F.min_by(job_seconds(F.col(started), F.col(finished)), order).alias("seconds"))


def job_seconds(started: Column, finished: Column) -> Column:
    """Seconds between epoch milliseconds, to a tenth."""
    return F.round((finished - started) / 100) / 10


def progress(jobs: DataFrame, updates: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Jobs with the counters of their updates where there are any."""
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return jobs.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in jobs.columns])


def trigger_chain(triggers: DataFrame, first: str) -> DataFrame:
    """job and distance of all jobs that a trigger sets off: ``triggers`` has on and job; a finished job is a trigger itself."""
    edges = triggers.select(F.col("on").alias("target"), F.col("job").alias("source"))
    from leafmill.operators.links import closure

    reached = closure(edges, triggers.sparkSession.createDataFrame([(first,)], "node string"))
    return reached.where("distance > 0").select(F.col("node").alias("job"), "distance")


def keyset_page(log: DataFrame, order: tuple[str, ...], bound: tuple, older: bool, limit: int) -> DataFrame:
    """The page before or after a row, by its order values, in ascending order."""
    here, there = F.struct(*order), F.struct(*[F.lit(b).alias(c) for b, c in zip(bound, order, strict=True)])
    part = log.where(here < there).orderBy(*[F.desc(c) for c in order]) if older else log.where(here > there).orderBy(*order)
    return part.limit(limit).orderBy(*order)
