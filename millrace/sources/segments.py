"""A table of Parquet segments with a commit log, as a data source written in Python: batch reads with filters pushed to segments,
writes in two phases, and streams with offsets.

A write task puts its rows into one new file and tells its name, rows, and the least and greatest value of each column. Only when
all tasks have done so does the driver name the files in a new entry of the log, under a temporary name first. A reader looks at
the files of the log alone: those of a task that was killed, or ran twice, or of a job that failed, are never read; a failed job
deletes what it knows of. One job writes at a time. Entries are numbered, and the numbers are a stream's offsets.

    table/data/<name>.parquet
    table/log/<number>.json      {"overwrite": false, "files": [{"name", "rows", "least": {}, "greatest": {}, "nulls": {}}]}
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..registry import query
from ..storage import fresh_path
from ..tables import table

NAME = "millrace_segments"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def segments_source() -> type[DataSource]:
    """The source's class. All of it is made here, so it is sent by value and workers need not import this package."""

    def store(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))

    def entries(path: str) -> dict[int, dict]:
        """The log's entries by number."""
        import json

        from pyarrow import fs

        system, root = store(path)
        found = system.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
        out = {}
        for f in sorted(found, key=lambda f: f.base_name):
            if f.base_name.endswith(".json"):
                with system.open_input_stream(f.path) as s:
                    out[int(f.base_name[:-5])] = json.loads(s.read())
        return out

    def current(path: str) -> list[dict]:
        files: list[dict] = []
        for _, entry in sorted(entries(path).items()):
            files = entry["files"] if entry["overwrite"] else files + entry["files"]
        return files

    def plain(value: object) -> object:
        """A value that JSON keeps, and that compares with others of its column; None for other kinds."""
        return value if isinstance(value, (int, float, str)) and not isinstance(value, bool) and value == value else None

    def may_hold(f: dict, pushed: Filter) -> bool:
        """Whether a file may hold a row that meets the filter."""
        column = pushed.attribute[0] if len(pushed.attribute) == 1 else None
        if isinstance(pushed, IsNotNull):
            return f["nulls"].get(column, 0) < f["rows"]
        low, high = f["least"].get(column), f["greatest"].get(column)
        if low is None or high is None:
            return True
        wanted = list(pushed.value) if isinstance(pushed, In) else [pushed.value]
        if any(isinstance(v, str) != isinstance(low, str) or plain(v) is None for v in wanted):
            return True
        if isinstance(pushed, (EqualTo, In)):
            return any(low <= v <= high for v in wanted)
        v = wanted[0]
        return {GreaterThan: high > v, GreaterThanOrEqual: high >= v, LessThan: low < v, LessThanOrEqual: low <= v}[type(pushed)]

    class Segment(InputPartition):
        def __init__(self, name: str) -> None:
            self.name = name

    class Written(WriterCommitMessage):
        def __init__(self, file: dict | None) -> None:
            self.file = file

    def read(path: str, name: str, columns: list[str]) -> Iterator:
        import pyarrow.parquet as pq

        system, root = store(path)
        with system.open_input_file(f"{root}/data/{name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=columns):
                yield batch.select(columns)

    class Reader(DataSourceReader):
        def __init__(self, path: str, columns: list[str]) -> None:
            self.path, self.columns, self.pushed = path, columns, []

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            for f in filters:
                if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                    self.pushed.append(f)
                yield f  # files are left out by it, rows are Spark's to filter

        def partitions(self) -> list[InputPartition]:
            return [Segment(f["name"]) for f in current(self.path) if all(may_hold(f, p) for p in self.pushed)]

        def read(self, partition: Segment) -> Iterator:
            if partition is not None:
                yield from read(self.path, partition.name, self.columns)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, path: str, columns: list[str]) -> None:
            self.path, self.columns = path, columns

        def initialOffset(self) -> dict:
            return {"entry": 0}

        def latestOffset(self) -> dict:
            return {"entry": max(entries(self.path), default=0)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            new = {n: e for n, e in entries(self.path).items() if start["entry"] < n <= end["entry"]}
            if any(e["overwrite"] for n, e in new.items() if n > 1):
                raise ValueError("the table was overwritten under a stream")
            return [Segment(f["name"]) for _, e in sorted(new.items()) for f in e["files"]]

        def read(self, partition: Segment) -> Iterator:
            yield from read(self.path, partition.name, self.columns)

        def commit(self, end: dict) -> None:
            pass

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str, overwrite: bool) -> None:
            self.path, self.overwrite = path, overwrite

        def write(self, iterator: Iterator) -> WriterCommitMessage:
            import uuid

            import pyarrow.compute as pc
            import pyarrow.parquet as pq

            system, root = store(self.path)
            name, rows, least, greatest, nulls, writer, out = f"{uuid.uuid4().hex}.parquet", 0, {}, {}, {}, None, None
            unordered: set[str] = set()
            try:
                for batch in iterator:
                    if writer is None:
                        system.create_dir(f"{root}/data", recursive=True)
                        out = system.open_output_stream(f"{root}/data/{name}")
                        writer = pq.ParquetWriter(out, batch.schema)
                    writer.write_batch(batch)
                    rows += batch.num_rows
                    for c, column in zip(batch.schema.names, batch.columns):
                        nulls[c] = nulls.get(c, 0) + column.null_count
                        if column.null_count == len(column) or c in unordered:
                            continue
                        try:
                            ends = pc.min_max(column).as_py()
                        except Exception:  # noqa: BLE001  a type without order
                            ends = {"min": None, "max": None}
                        low, high = plain(ends["min"]), plain(ends["max"])
                        if low is None or high is None:
                            unordered.add(c)
                            least.pop(c, None), greatest.pop(c, None)
                        else:
                            least[c], greatest[c] = min(least.get(c, low), low), max(greatest.get(c, high), high)
            finally:
                if writer is not None:
                    writer.close()
                    out.close()
            return Written({"name": name, "rows": rows, "least": least, "greatest": greatest, "nulls": nulls} if writer is not None else None)

        def commit(self, messages: list[Written | None]) -> None:
            import json
            import uuid

            system, root = store(self.path)
            system.create_dir(f"{root}/log", recursive=True)
            number = max(entries(self.path), default=0) + 1
            body = json.dumps({"overwrite": self.overwrite, "files": [m.file for m in messages if m is not None and m.file is not None]})
            temporary = f"{root}/log/.{number}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as s:
                s.write(body.encode())
            system.move(temporary, f"{root}/log/{number:012d}.json")

        def abort(self, messages: list[Written | None]) -> None:
            system, root = store(self.path)
            for m in messages:
                if m is not None and m.file is not None:
                    system.delete_file(f"{root}/data/{m.file['name']}")

    class Segments(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def reader(self, schema: object) -> DataSourceReader:
            return Reader(self.options["path"], schema.names)

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            return StreamReader(self.options["path"], schema.names)

        def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
            return Writer(self.options["path"], overwrite)

    return Segments


def register(spark: SparkSession) -> None:
    spark.dataSource.register(segments_source())
    spark.conf.set(_PUSHDOWN, "true")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 400 AND 900 AND o_orderpriority <> '5-LOW'")
def py_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, written in segments by range of key; the filter reads those alone that may hold such keys."""
    register(spark)
    path, orders = fresh_path(spark, "segments"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    orders.repartitionByRange(8, "o_orderkey").write.format(NAME).mode("append").save(path)
    read = spark.read.format(NAME).schema(orders.schema).load(path)
    return read.where("o_orderkey BETWEEN 400 AND 900 AND o_orderpriority <> '5-LOW'").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT s_nationkey, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier GROUP BY s_nationkey")
def py_source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, committed in three jobs, as a stream that is counted."""
    from ..streaming.events import drained  # which the registry loads after the sources

    register(spark)
    path, s = fresh_path(spark, "segments-stream"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    for third in range(3):
        s.where(F.col("s_suppkey") % 3 == third).write.format(NAME).mode("append").save(path)
    read = spark.readStream.format(NAME).schema(s.schema).load(path)
    return drained(read.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys")), "complete")
