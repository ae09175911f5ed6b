"""Streams with state of their own: freshness by timers, pairing of two streams, verdicts on files.

They give changes as rows, append them to a log by batch, and keep a table that the log is folded into
(``sources.buckets``), so neither state nor output grows with what is silent.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from wavecohort.functions.values import MAX_FILE_BYTES
from wavecohort.operators.intervals import PAIR_WINDOW_S
from wavecohort.sources import buckets
from wavecohort.sources.bundles import file_verdict
from wavecohort.streaming.streams import each_batch

STALE_S = 48 * 3600.0
FRESH_DDL = "subject_id string, last_ts double, rows bigint, stale boolean, told_at double"
PAIRED_DDL = "reading_id string, subject_id string, t double, session_id bigint, gap double"


def _processor(stale_s: float, by_event: bool) -> StatefulProcessor:
    class Freshness(StatefulProcessor):
        """Last activity and rows of a subject, and one timer at the moment it turns stale."""

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("freshness", "last_ts double, rows bigint, due bigint")

        def _now(self, times) -> float:
            return (times.getCurrentWatermarkInMs() if by_event else times.getCurrentProcessingTimeInMs()) / 1000

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            last, n, due = self.state.get() or (None, 0, None)
            for r in rows:
                n += 1
                if r.ts is not None and (last is None or r.ts > last):
                    last = r.ts
            now = self._now(timerValues)
            stale = last is not None and now > last + stale_s
            wanted = None if stale or last is None else int((last + stale_s) * 1000) + 1
            if wanted != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                if wanted is not None:
                    self.handle.registerTimer(wanted)
            self.state.update((last, n, wanted))
            yield Row(subject_id=key[0], last_ts=last, rows=n, stale=stale, told_at=now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            last, n, _ = self.state.get()
            self.state.update((last, n, None))
            yield Row(subject_id=key[0], last_ts=last, rows=n, stale=True, told_at=self._now(timerValues))

        def close(self) -> None:
            pass

    return Freshness()


def freshness(stream: DataFrame, stale_s: float = STALE_S, late: str | None = None) -> DataFrame:
    """Changes of each subject's freshness: one row for a subject with new rows, one when it turns stale.

    ``stream`` has subject_id and ts. State is one small row and one timer per subject; a silent one turns
    stale by its timer, whoever else sends rows. The clock is that of the machine; with ``late`` it is the
    watermark, that far behind the newest row of any subject, and rows behind it are dropped. Rows without
    a time are counted but say nothing of freshness. Rows without a subject are one subject.
    """
    rows = stream.select("subject_id", F.col("ts").cast("double").alias("ts"))
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint"))).withWatermark("at", late)
    mode = "ProcessingTime" if late is None else "EventTime"
    return rows.groupBy("subject_id").transformWithState(_processor(stale_s, late is not None), FRESH_DDL, "Update", mode)


def keep_freshness(changes: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Log the changes below ``root``; a batch holds only subjects that changed in it."""
    return each_batch(changes, checkpoint, lambda batch, number: buckets.log_batch(batch, root, number), "update", trigger)


def _fresh_schema(batch: bool = True) -> StructType:
    return StructType.fromDDL(FRESH_DDL + (", batch bigint" if batch else ""))


def _latest(old: DataFrame, new: DataFrame) -> DataFrame:
    state = F.struct("last_ts", "rows", "stale", "told_at", "batch")
    both = old.unionByName(new)
    return both.groupBy("subject_id").agg(F.max_by(state, F.struct("batch", "rows", "told_at", "stale")).alias("s")).select("subject_id", "s.*")


def fresh_subjects(spark: SparkSession, root: str) -> DataFrame:
    """Every subject's latest state: last_ts, rows, stale and when that was told."""
    table = buckets.read_buckets(spark, f"{root}/table", _fresh_schema())
    return _latest(table, buckets.unfolded(spark, root, _fresh_schema(False))).drop("batch")


def fold_freshness(spark: SparkSession, root: str) -> None:
    """Fold the logged changes into the buckets of the subjects they name."""
    buckets.fold(spark, root, _fresh_schema(), _fresh_schema(False), ["subject_id"], _latest)


def _sweep(tolerance: float) -> Callable[[list[float], list[tuple]], list[tuple | None]]:
    """A function without names of this module, so that Python workers need no copy of it."""

    def nearest(times: list[float], spans: list[tuple]) -> list[tuple | None]:
        """For each time the (gap, id) of the smallest gap, then the smallest id, or None if none is within ``tolerance``.

        Spans are (id, start, end). Each takes the places inside it that no smaller id has taken; places that none
        holds look at the last end before and the first start after. No pair is enumerated.
        """
        order = sorted(range(len(times)), key=times.__getitem__)
        t = [times[i] for i in order]
        found: list[tuple | None] = [None] * len(t)
        free = list(range(len(t) + 1))  # the next place that is not taken, with shortcuts

        def place(i: int) -> int:
            while free[i] != i:
                free[i] = i = free[free[i]]
            return i

        ends, starts = {}, {}
        for x, s, e in sorted(spans):
            ends.setdefault(e, x)
            starts.setdefault(s, x)
            i, last = place(bisect_left(t, s)), bisect_right(t, e)
            while i < last:
                found[i], free[i] = (0.0, x), i + 1
                i = place(i)
        low, high = sorted(ends), sorted(starts)
        for i, at in enumerate(t):
            if found[i] is None:
                before, after = bisect_left(low, at) - 1, bisect_right(high, at)
                near = [(at - low[before], ends[low[before]])] if before >= 0 and at <= low[before] + tolerance else []
                if after < len(high) and at >= high[after] - tolerance:
                    near.append((high[after] - at, starts[high[after]]))
                found[i] = min(near, default=None)
        back: list[tuple | None] = [None] * len(t)
        for i, f in zip(order, found):
            back[i] = f
        return back

    return nearest


def _pairer(schema: StructType, tolerance: float, slot_s: float) -> StatefulProcessor:
    reading, _, _, session, _ = (f.dataType.simpleString() for f in schema)
    wait, nearest = int(tolerance) + 1, _sweep(tolerance)

    class Pair(StatefulProcessor):
        """Readings and recordings of a subject in one time slot, and a timer for the first that nothing can still meet."""

        def init(self, handle) -> None:
            self.handle = handle
            self.points = handle.getListState("points", f"reading_id {reading}, t double, session_id {session}, gap double")
            self.spans = handle.getListState("spans", f"session_id {session}, s double, e double")

        def _row(self, key, p) -> Row:
            return Row(reading_id=p[0], subject_id=key[0], t=p[1], session_id=p[2], gap=p[3])

        def _due(self, key, points) -> int:
            """The timer of the first reading without a recording, or of the slot's end."""
            return int((min([p[1] for p in points if p[2] is None] + [(key[1] + 1) * slot_s]) + wait) * 1000) + 1

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            came, spans = [], []
            for r in rows:
                if r.session_id is None:
                    came.append((r.reading_id, r.t, None, None))
                else:
                    spans.append((r.session_id, r.s, r.e))
            old = [tuple(p) for p in self.points.get()]
            known = [tuple(x) for x in self.spans.get()] if came or not old else []
            points = []
            for some, against in ((old, spans), (came, known + spans)):
                for p, near in zip(some, nearest([p[1] for p in some], against) if against else [None] * len(some)):
                    if near is not None and (p[2] is None or near < (p[3], p[2])):
                        p = (p[0], p[1], near[1], near[0])
                        yield self._row(key, p)
                    points.append(p)
            if points != old:
                self.points.put(points)
            if spans:
                self.spans.appendList(spans)
            due, wanted = self._due(key, old) if old or known else None, self._due(key, points)
            if wanted != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(wanted)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now, points = timerValues.getCurrentWatermarkInMs(), [tuple(p) for p in self.points.get()]
            gone = lambda t: int((t + wait) * 1000) + 1 <= now
            yield from (self._row(key, p) for p in points if p[2] is None and gone(p[1]))
            if gone((key[1] + 1) * slot_s):
                self.points.clear()
                self.spans.clear()
                return
            left = [p for p in points if not gone(p[1])]
            if left:
                self.points.put(left)
            else:
                self.points.clear()
            self.handle.registerTimer(self._due(key, left))

        def close(self) -> None:
            pass

    return Pair()


def pair_streams(
    readings: DataFrame,
    recordings: DataFrame,
    tolerance: float = PAIR_WINDOW_S,
    late: str = "2 hours",
    piece_s: float = 6 * 3600.0,
) -> DataFrame:
    """Readings with the recording of their subject that holds them within ``tolerance`` seconds at the smallest gap, then id.

    Both sides are streams: ``readings`` has reading_id, subject_id and t, ``recordings`` id, subject_id, start_time and
    end_time. Either may come first; a reading is told again when a better recording comes, and ``best_pairs`` picks the
    last. A reading that no recording holds is given with a null session_id once the
    watermark has passed all recordings it could still meet. Rows more than ``late`` behind are
    dropped, so state holds what lies within ``late``, ``tolerance`` and ``piece_s`` of the watermark, for ever long
    recordings too: they enter as one piece for each time slot of ``piece_s`` they reach into. Work is dealt by subject and
    slot, and a sweep over a slot finds the recordings, so that cost follows rows, not pairs. An open or NaN end means
    length zero. Rows without an id of the recording, a time or a start are left out.
    """
    stamp = lambda c: F.timestamp_micros(F.round(c * 1e6).cast("bigint"))
    slot = lambda c: F.floor(c / piece_s).cast("bigint")
    points = readings.where(F.col("t").isNotNull()).select(
        "reading_id", "subject_id", "t", stamp(F.col("t")).alias("at"), slot(F.col("t")).alias("slot")
    ).withWatermark("at", late)
    ends = F.greatest(F.coalesce(F.nanvl(F.col("end_time").cast("double"), "start_time"), "start_time"), F.col("start_time"))
    spans = recordings.where(F.col("start_time").isNotNull() & F.col("id").isNotNull() & F.col("subject_id").isNotNull()).select(
        F.col("id").alias("session_id"), "subject_id", F.col("start_time").alias("s"), ends.alias("e")
    )
    slots = F.sequence(slot(F.col("s") - tolerance), slot(F.col("e") + tolerance))
    pieces = spans.select("*", F.explode(slots).alias("slot"))
    pieces = pieces.withColumn("at", stamp(F.greatest("s", F.col("slot") * piece_s))).withWatermark("at", late)
    schema = StructType([*readings.select("reading_id", "subject_id", "t").schema.fields, *recordings.select(F.col("id").alias("session_id")).schema.fields, *StructType.fromDDL("gap double").fields])
    schema = StructType.fromDDL(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    both = points.unionByName(pieces, allowMissingColumns=True)
    return both.groupBy("subject_id", "slot").transformWithState(_pairer(schema, tolerance, piece_s), schema, "Append", "EventTime")


def keep_pairs(pairs: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Log the pairs, and the readings that expired without one, below ``root``."""
    return each_batch(pairs, checkpoint, lambda batch, number: buckets.log_batch(batch, root, number), trigger=trigger)


def _best(old: DataFrame, new: DataFrame) -> DataFrame:
    pair = F.struct("subject_id", "t", "session_id", "gap")
    both = old.unionByName(new.select(*old.columns))
    # Any pair comes before none; of pairs the smallest gap, then the smallest id.
    order = F.struct(F.col("session_id").isNull(), "gap", "session_id")
    return both.groupBy("reading_id").agg(F.min_by(pair, order).alias("p")).select("reading_id", "p.*")


def best_pairs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each reading told so far, with the recording of the smallest gap, then the smallest id, or none."""
    schema = StructType.fromDDL(PAIRED_DDL)
    return _best(buckets.read_buckets(spark, f"{root}/table", schema), buckets.unfolded(spark, root, schema))


def fold_pairs(spark: SparkSession, root: str) -> None:
    """Fold the logged pairs into the buckets of their readings."""
    schema = StructType.fromDDL(PAIRED_DDL)
    buckets.fold(spark, root, schema, schema, ["reading_id"], _best)


# ---- files: repeated arrivals and deadlines

VERDICT_DDL = "upload string, name string, sha256 string, bytes bigint, verdict string, told_at double"


def _file_processor(deadline_s: float, keep_s: float) -> StatefulProcessor:
    class Files(StatefulProcessor):
        """What is declared of a file, what came last, what was told; a timer for the deadline, then one to forget."""

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("file", "declared string, sha string, bytes bigint, fault string, told string, due bigint, passed boolean")

        def _told(self, key, sha, size, verdict, times) -> Row:
            return Row(upload=key[0], name=key[1], sha256=sha, bytes=size, verdict=verdict, told_at=times.getCurrentWatermarkInMs() / 1000)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            declared, sha, size, fault, told, due, passed = self.state.get() or (None, None, None, None, None, None, False)
            before = told, sha
            for r in sorted(rows, key=lambda r: (r.at, r.sha256 or "", r.declared or "")):
                if due is None:
                    due = int((r.at.timestamp() + deadline_s) * 1000)
                    self.handle.registerTimer(due)
                if r.sha256 is None:
                    declared = r.declared
                else:
                    sha, size, fault = r.sha256, r.bytes, r.fault
            verdict = told
            if sha is not None:  # without content nothing is told before the deadline
                verdict = fault or ("undeclared" if declared is None else "ok" if declared == sha else "mismatch")
            self.state.update((declared, sha, size, fault, verdict, due, passed))
            if (verdict, sha) != before:
                yield self._told(key, sha, size, verdict, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            declared, sha, size, fault, told, due, passed = self.state.get()
            if passed:
                self.state.clear()
                return
            forget = due + int(keep_s * 1000)
            self.handle.registerTimer(forget)
            self.state.update((declared, sha, size, fault, told if sha else "missing", forget, True))
            if sha is None:
                yield self._told(key, None, None, "missing", timerValues)

        def close(self) -> None:
            pass

    return Files()


def file_verdicts(
    files: DataFrame,
    declared: DataFrame,
    deadline_s: float,
    late: str = "1 hour",
    keep_s: float = 7 * 86400.0,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Changes of content or verdict of each file of an upload, told once however often it is sent.

    ``files`` has upload, name, content and ``at`` (a timestamp), ``declared`` upload, name, sha256 and ``at``; both are
    streams, in any order. The last content and the last declaration by ``at`` count, so a file may turn from
    undeclared or mismatch to ok. A declared file that has not come ``deadline_s`` after its declaration by the
    watermark is told ``missing`` once, and its verdict if it comes after all. A file's state is dropped
    ``keep_s`` after its deadline; only hashes are held. Rows without a time are left out.
    """
    facts = files.where(F.col("at").isNotNull()).select(
        "upload", "name", "at", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.lit(None).cast("string").alias("declared")
    ).where(F.col("sha256").isNotNull())
    verdict = file_verdict(max_bytes)
    faulty = F.when(verdict.isin("illegal_name", "empty", "too_large"), verdict)
    sent = facts.withColumn("fault", faulty)
    told = declared.where(F.col("at").isNotNull() & F.col("sha256").isNotNull()).select(
        "upload", "name", "at", F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.col("sha256").alias("declared"), F.lit(None).cast("string").alias("fault")
    )
    both = sent.select(*told.columns).unionByName(told).withWatermark("at", late)
    return both.groupBy("upload", "name").transformWithState(_file_processor(deadline_s, keep_s), VERDICT_DDL, "Update", "EventTime")


def keep_verdicts(changes: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Log the verdicts below ``root``."""
    return each_batch(changes, checkpoint, lambda batch, number: buckets.log_batch(batch, root, number), "update", trigger)


def _last_told(old: DataFrame, new: DataFrame) -> DataFrame:
    state = F.struct("sha256", "bytes", "verdict", "told_at", "batch")
    return old.unionByName(new).groupBy("upload", "name").agg(F.max_by(state, F.struct("batch", "told_at")).alias("s")).select("upload", "name", "s.*")


def current_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """The last verdict told of every file."""
    logged = StructType.fromDDL(VERDICT_DDL)
    table = buckets.read_buckets(spark, f"{root}/table", StructType.fromDDL(VERDICT_DDL + ", batch bigint"))
    return _last_told(table, buckets.unfolded(spark, root, logged)).drop("batch")


def fold_verdicts(spark: SparkSession, root: str) -> None:
    """Fold the logged verdicts into the buckets of their files."""
    kept = StructType.fromDDL(VERDICT_DDL + ", batch bigint")
    buckets.fold(spark, root, kept, StructType.fromDDL(VERDICT_DDL), ["upload", "name"], _last_told)


# ---- runs of hot subjects: slices first, then what meets at their borders

def _stitcher(schema: StructType, gap_us: int, slice_us: int) -> StatefulProcessor:
    keys = schema.names[:-3]

    class Stitch(StatefulProcessor):
        """The run of a subject that may still go on in the next slice, and a timer for when it cannot."""

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("run", "first bigint, last bigint, points bigint, first_ts double, last_ts double, due bigint")

        def _run(self, key, run) -> Row:
            return Row(**dict(zip(keys, key)), first_ts=run[3], last_ts=run[4], points=run[2])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            pieces = ((r.first, r.last, r.points, r.first_ts, r.last_ts) for r in rows)
            if key[-1] is not None:  # inside its slice, nothing can join it
                yield from (self._run(key, p) for p in pieces)
                return
            held = self.state.get()
            run, due = (held[:5], held[5]) if held else (None, None)
            for p in sorted(pieces):
                if run is not None and p[0] - run[1] <= gap_us:
                    run = (min(run[0], p[0]), max(run[1], p[1]), run[2] + p[2], min(run[3], p[3]), max(run[4], p[4]))
                else:
                    if run is not None:
                        yield self._run(key, run)
                    run = p
            # What still joins begins within the gap and ends with its slice; then its own gap passes.
            wanted = (run[1] + 2 * gap_us + slice_us) // 1000 + 2
            if wanted != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(wanted)
            self.state.update((*run, wanted))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            yield self._run(key, self.state.get())
            self.state.clear()

        def close(self) -> None:
            pass

    return Stitch()


def sliced_runs(stream: DataFrame, keys: tuple[str, ...], gap_s: int, slice_s: int = 3600, late: str = "2 hours") -> DataFrame:
    """``recording_runs`` for keys that may hold most of all rows: runs of each time slice, stitched at its borders.

    ``stream`` has ``keys`` and ts. A first operator keeps the open runs of each (key, slice), so that a key is spread over its
    slices. The second gets one row for each such run: those further than ``gap_s`` from both borders are final and
    are dealt by slice too; the others, at most three a slice, meet by key, where one open run is held, not
    the key's rows. A run that ends near a border is given once the watermark has passed its end by twice the gap and a slice,
    any other once it has passed it by the gap. Runs still open when the stream ends are not given yet. Null keys
    are one key; rows without a time are left out, and those more than ``late`` behind, times before 1970 among them.
    """
    gap_us, slice_us = gap_s * 10**6, slice_s * 10**6
    timed = stream.select(*keys, F.col("ts").cast("double").alias("ts")).withColumn("at", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint")))
    micros = F.unix_micros("at")
    sliced = timed.withWatermark("at", late).withColumn("slice", micros - F.pmod(micros, F.lit(slice_us)))
    # One microsecond more keeps a step of exactly the gap inside the run.
    pieces = sliced.groupBy(F.session_window("at", f"{gap_s} seconds 1 microsecond"), *keys, "slice").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    first, last = F.unix_micros("first"), F.unix_micros("last")
    inside = (first - F.col("slice") > gap_us) & (F.col("slice") + slice_us - last > gap_us)
    pieces = pieces.select("session_window", *keys, F.when(inside, F.col("slice")).alias("inner"), first.alias("first"), last.alias("last"), "points", "first_ts", "last_ts")
    schema = StructType([*stream.select(*keys).schema.fields, *StructType.fromDDL("first_ts double, last_ts double, points bigint").fields])
    return pieces.groupBy(*keys, "inner").transformWithState(_stitcher(schema, gap_us, slice_us), schema, "Append", "EventTime")
