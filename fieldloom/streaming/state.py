"""State that streams keep between micro-batches.

A state log is a keyed table as runs of changed rows. A batch writes one run
that holds only the keys it changed, looks up only the buckets of its own keys,
and merges runs of one level once there are FAN of them, so n batches leave at
most (FAN - 1) runs on each of log(n) levels and a row is rewritten log(n) times.

Everything a batch leaves behind becomes valid by one rename of its manifest,
which names the runs of all logs, the watermark and the rows still held back. A
batch that is run again starts from its predecessor's manifest and overwrites
its own folders. Runs that neither manifest names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.sources.tables import write_version

FAN = 8
BUCKETS = 16            # folders of a run; spark.fieldloom.state.buckets, fixed for the life of a stream
SEED = "seed"


class Files:
    """The few calls to Hadoop's file system that Spark's readers and writers do not cover."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def remove(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def replace(self, path: str, text: str) -> None:
        """Write beside the path, then rename."""
        fs, at = self._at(path)
        fresh = self._at(path + ".new")[1]
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(at, False)
        if not fs.rename(fresh, at):
            raise OSError(f"cannot rename {path}.new")


class StateLog:
    """One keyed table of a stream's state."""

    def __init__(self, state: StreamState, name: str, keys: Sequence[str], schema: T.StructType | str):
        self.state, self.name, self.keys = state, name, list(keys)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.folder = f"{state.folder}/state/{name}"
        self.runs: list[list] = state.logs.setdefault(name, [])     # [level, run], oldest first
        self.buckets = int(state.spark.conf.get("spark.fieldloom.state.buckets", str(BUCKETS)))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self, runs: Sequence[str]) -> DataFrame:
        spark = self.state.spark
        fields = T.StructType([*self.schema, T.StructField("_version", T.LongType()),
                               T.StructField("_run", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        if not runs:
            return spark.createDataFrame([], fields)
        return (spark.read.schema(fields).option("basePath", self.folder)
                .parquet(*[f"{self.folder}/_run={r}" for r in runs]))

    def _latest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in self.schema.names if c not in self.keys]
        if not values:
            return rows.select(*self.keys).distinct()
        newest = F.max_by(F.struct(*values), "_version").alias("_row")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*").select(*self.schema.names)

    def read(self) -> DataFrame:
        """The current row of every key."""
        return self._latest(self._stored([run for _, run in self.runs]))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The current rows of the keys of ``wanted``; only their buckets are read."""
        if not self.runs:
            return self._latest(self._stored([]))
        keys = wanted.select(*self.keys).distinct()
        touched = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]      # one number per bucket at most
        rows = self._stored([run for _, run in self.runs]).filter(F.col("_bucket").isin(touched))
        named = keys.select(*[F.col(k).alias(f"_wanted_{k}") for k in self.keys])
        match = [F.col(k).eqNullSafe(F.col(f"_wanted_{k}")) for k in self.keys]
        return self._latest(rows.join(named, match, "left_semi"))

    def put(self, changed: DataFrame, seed: bool = False) -> None:
        """Write the changed keys' rows, one per key, as a run; merge runs where there are enough."""
        version = -1 if seed else self.state.batch_id
        run = SEED if seed else str(self.state.batch_id)
        self._write(changed.select(*self.schema.names).withColumn("_version", F.lit(version).cast("long")), run)
        self.runs.append([0, run])
        level = 0
        while sum(at == level for at, _ in self.runs) >= FAN:
            merged = [r for at, r in self.runs if at == level]
            values = [c for c in self.schema.names if c not in self.keys]
            newest = (self._stored(merged).groupBy(*self.keys)
                      .agg(F.max_by(F.struct(*values, "_version") if values else F.struct("_version"), "_version").alias("_row"))
                      .select(*self.keys, "_row.*"))
            level += 1
            run = f"{self.state.batch_id}-{level}"
            self._write(newest, run)
            # runs of a higher level are older
            self.runs[:] = [x for x in self.runs if x[0] > level - 1] + [[level, run]] + [x for x in self.runs if x[0] < level - 1]

    def _write(self, rows: DataFrame, run: str) -> None:
        split = max(1, int(self.state.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        (rows.withColumn("_bucket", self._bucket())
         .repartition("_bucket", F.pmod(F.xxhash64(F.lit(7), *self.keys), F.lit(split)))
         .write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/_run={run}"))


class StreamState:
    """What the batch before this one left; ``commit`` makes this batch's state the current one."""

    def __init__(self, spark: SparkSession, folder: str, batch_id: int):
        self.spark, self.folder, self.batch_id, self.files = spark, folder, batch_id, Files(spark)
        found = {"logs": {}, "watermark": None, "held": [], "ended": False}
        if batch_id > 0:
            found = json.loads(self.files.read(self._manifest(batch_id - 1)))
        self.before = json.loads(json.dumps(found))
        self.logs: dict[str, list] = found["logs"]
        self.watermark = found["watermark"]
        self.held: list[list] = found["held"]       # [run, time of its first row]
        self.ended = found["ended"]
        self.released = False

    @classmethod
    def latest(cls, spark: SparkSession, folder: str, ended: bool = True) -> StreamState:
        """The state after the last committed batch, of those that did not end the stream if ``ended`` is false."""
        done = sorted((int(n) for n in Files(spark).names(f"{folder}/manifest") if n.isdigit()), reverse=True)
        for batch_id in done:
            state = cls(spark, folder, batch_id + 1)
            if ended or not state.ended:
                return state
        return cls(spark, folder, 0)

    def _manifest(self, batch_id: int) -> str:
        return f"{self.folder}/manifest/{batch_id}"

    def log(self, name: str, keys: Sequence[str], schema: T.StructType | str) -> StateLog:
        return StateLog(self, name, keys, schema)

    def release(self, batch: DataFrame, at: str, delay: timedelta | None) -> tuple[DataFrame, DataFrame]:
        """(due, late): held and new rows up to the watermark, and new rows behind the last one.

        The watermark trails the latest event by ``delay``; None ends the
        stream and releases everything. Rows beyond it are held for a later
        batch, in runs with the time of their first row: a run is read and
        written again only once some of it is due. A row without a time is
        late, as its place is unknown. ``released`` tells whether any may be due.
        """
        time = F.col(at)
        behind = time.isNull()
        if self.watermark is not None:
            behind = behind | (time <= F.lit(datetime.fromisoformat(self.watermark)).cast("timestamp_ntz"))
        fresh, nothing = batch.filter(~behind), batch.limit(0)
        if delay is None:
            waiting = self._waiting(fresh, self.held)
            self.held, self.ended, self.released = [], True, True
            return waiting, batch.filter(behind)
        first, newest, n_late = batch.agg(
            F.min(F.when(~behind, time)), F.max(F.when(~behind, time)), F.count_if(behind)).first()
        late = batch.filter(behind) if n_late else nothing
        if newest is not None:
            reached = (newest - delay).isoformat()
            self.watermark = max(self.watermark or reached, reached, key=datetime.fromisoformat)
        if self.watermark is None:
            return nothing, late
        if not delay and not self.held:
            self.released = newest is not None
            return fresh, late          # nothing is later than the latest
        reached = datetime.fromisoformat(self.watermark)
        touched = [run for run in self.held if datetime.fromisoformat(run[1]) <= reached]
        self.released = bool(touched) or (first is not None and first <= reached)
        if not touched and newest is None:
            return nothing, late
        waiting = self._waiting(fresh, touched)
        due = time <= F.lit(reached).cast("timestamp_ntz")
        path = f"{self.folder}/held/{self.batch_id}"
        write_version(waiting.filter(~due) if self.released else waiting, path)
        self.held = [run for run in self.held if run not in touched]
        if self.released:
            first = self.spark.read.schema(batch.schema).parquet(path).agg(F.min(at)).first()[0]
        if first is not None:
            self.held.append([str(self.batch_id), first.isoformat()])
        return waiting.filter(due) if self.released else nothing, late

    def _waiting(self, fresh: DataFrame, runs: Sequence[list]) -> DataFrame:
        if not runs:
            return fresh
        held = self.spark.read.schema(fresh.schema).parquet(*[f"{self.folder}/held/{run}" for run, _ in runs])
        return held.unionByName(fresh)

    def commit(self) -> None:
        now = {"logs": self.logs, "watermark": self.watermark, "held": self.held, "ended": self.ended}
        self.files.replace(self._manifest(self.batch_id), json.dumps(now))
        for name in self.logs:
            used = {run for found in (self.before, now) for _, run in found["logs"].get(name, [])}
            for entry in self.files.names(f"{self.folder}/state/{name}"):
                if entry.startswith("_run=") and entry[5:] not in used:
                    self.files.remove(f"{self.folder}/state/{name}/{entry}")
        for entry in self.files.names(f"{self.folder}/held"):
            if entry not in {run for run, _ in [*self.before["held"], *self.held]}:
                self.files.remove(f"{self.folder}/held/{entry}")
        # a later batch needs its predecessor's manifest only
        self.files.remove(self._manifest(self.batch_id - 2))
