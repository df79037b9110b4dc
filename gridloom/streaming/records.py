"""Streams of records: appends along the record dimension, and the write-ahead log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..operators import update
from ..sources.cdf import CdfReader, read_header, schema_of


class RecordStream(DataSource):
    """``spark.readStream.format("cdf_records")``: the records of one variable as they appear; the offset is the record count."""

    @classmethod
    def name(cls):
        return "cdf_records"

    def schema(self):
        c = read_header(self.options["path"])
        return schema_of(c, c.var(self.options["var"]))

    def streamReader(self, schema):
        return _Records(self.options["path"], self.options["var"])


class _Records(DataSourceStreamReader):
    """A batch is a range of records, read in slabs by the executors."""

    def __init__(self, path: str, var: str):
        self.path, self.var = path, var

    def initialOffset(self):
        return {"numrecs": 0}

    def latestOffset(self):
        return {"numrecs": read_header(self.path).numrecs}

    def partitions(self, start, end):
        lo, hi = start["numrecs"], end["numrecs"]
        reader = CdfReader(self.path, self.var, {})
        reader.low[0], reader.high = lo, [hi, *reader.shape[1:]]
        return reader.partitions() if hi > lo else []

    def read(self, partition):
        yield from CdfReader(self.path, self.var, {}).read(partition)


class WriteLog:
    """Puts go to an append-only table (var, seq, coordinates, v), a folder a put, and reach the variables at a flush; the last write wins.

    ``limit``: bytes of cells that are applied in one round (0: all at once).
    """

    def __init__(self, spark: SparkSession, path: str, limit: int = 0):
        self.spark, self.path, self.limit, self.seq, self.flushed = spark, path, limit, 0, 0
        self.entries: list[dict] = []  # the call of each put: var, bytes, start, count, stride

    def put(self, var: str, cells: DataFrame, n_bytes: int = 0, start=None, count=None, stride=None) -> int:
        cells.withColumn("seq", F.lit(self.seq).cast("long")).withColumn("var", F.lit(var)).write.parquet(f"{self.path}/{self.seq}")
        self.entries.append({"var": var, "bytes": n_bytes, "start": start, "count": count, "stride": stride, "schema": cells.schema})
        self.seq += 1
        return self.seq - 1

    def _read(self, var: str, seqs: list[int]) -> DataFrame:
        schema = self.entries[seqs[0]]["schema"]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        return self.spark.read.schema(f"{fields}, seq long, var string").parquet(*[f"{self.path}/{k}" for k in seqs])

    def _of(self, var: str, first: int, end: int) -> list[int]:
        return [k for k in range(first, end) if self.entries[k]["var"] == var]

    def pending(self, var: str) -> DataFrame | None:
        seqs = self._of(var, self.flushed, self.seq)
        return self._read(var, seqs) if seqs else None

    def rounds(self):
        """The cells of each round by variable; a round holds the next puts up to the limit, one at least."""
        while self.flushed < self.seq:
            end, size = self.flushed, 0
            while end < self.seq and (end == self.flushed or not self.limit or size + self.entries[end]["bytes"] <= self.limit):
                size += self.entries[end]["bytes"]
                end += 1
            names = dict.fromkeys(self.entries[k]["var"] for k in range(self.flushed, end))
            part = {name: update.replay(self._read(name, self._of(name, self.flushed, end)).drop("var")) for name in names}
            self.flushed = end
            yield part

    def flush(self, cells: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The variables with all logged writes applied."""
        out = dict(cells)
        for part in self.rounds():
            for name, new in part.items():
                out[name] = update.put(out[name], new)
        return out

    def cancel(self, seq: int) -> None:
        from ..functions.types import ArrayError, Code

        if seq < self.flushed:
            raise ArrayError(Code.FLUSHED, str(seq))
        raise ArrayError(Code.NOTSUPPORT, "a logged write cannot be taken back")

    def calls(self) -> DataFrame:
        """The log as a list of calls with their arguments, for reading: seq, var, call, start, count, stride, bytes and n, the cells."""
        kind = lambda e: "put_var" if e["start"] is None else "put_vars" if e["stride"] else "put_vara"
        rows = [(k, e["var"], kind(e), e["start"], e["count"], e["stride"], e["bytes"]) for k, e in enumerate(self.entries)]
        told = self.spark.createDataFrame(rows, "seq long, var string, name string, start array<long>, count array<long>, stride array<long>, bytes long")
        sizes = None
        for k in range(self.seq):  # a scan for each put; counts come from the files' footers
            one = self.spark.read.parquet(f"{self.path}/{k}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).cast("long").alias("seq"), "n")
            sizes = one if sizes is None else sizes.unionByName(one)
        shown = lambda x: F.coalesce(F.concat(F.lit("["), F.array_join(F.col(x).cast("array<string>"), ", "), F.lit("]")), F.lit("-"))
        call = F.format_string("%s(%s, start %s, count %s, stride %s): %d cells", "name", "var", shown("start"), shown("count"), shown("stride"), F.coalesce("n", F.lit(0)))
        return told.withColumn("n", F.lit(0)) if sizes is None else told.join(sizes, "seq").withColumn("call", call).drop("name")
