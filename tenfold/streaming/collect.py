"""The collecting loop as a stream: what is queued comes from the commits of the stored tables.

The source reads the logs of players and matches by step: its offsets are commit numbers, and a
batch has the rows queued by the commits between two of them, whatever was merged since.  What a
batch stores is itself a commit, so players found in matches and matches listed for players come
back as later batches; the stream is idle when nothing new is queued.

A batch makes two commits, of the lists of players and of the answers to matches, each marked with
the batch's number.  Answers are written under that number before anything is stored.  So a query
that is stopped anywhere and started again repeats no commit, and asks nothing again that was
answered in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter

from tenfold.operators import ingest
from tenfold.operators.crawl import Fetch, Store
from tenfold.sources.tables import staged

#: Table, its key, a column that tells the queued rows from the others, and its value in them.
QUEUES = {"player": ("crawl_players", "puuid", "processed_at", None), "match": ("crawl_matches", "match_id", "state", "pending")}


class QueuedFile(InputPartition):
    def __init__(self, kind: str, path: str, after: int, upto: int):
        self.kind, self.path, self.after, self.upto = kind, path, after, upto


class QueuedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def _manifest(self) -> dict:
        import json

        from pyarrow import fs

        files, root = self._files()
        found = files.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
        names = sorted(x.path for x in found if x.path.endswith(".json"))
        if not names:
            return {"number": 0, "tables": {}}
        with files.open_input_stream(names[-1]) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": self._manifest()["number"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        files, root = self._files()
        out: list[InputPartition] = []
        for kind, (table, *_) in QUEUES.items():
            for folder, _ in self._manifest()["tables"].get(table, []):
                out += [QueuedFile(kind, x.path, start["commit"], end["commit"]) for x in files.get_file_info(fs.FileSelector(f"{root}/{table}/{folder}")) if x.path.endswith(".parquet")]
        return out

    def read(self, partition: QueuedFile) -> Iterator[Any]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        files, _ = self._files()
        _, key, column, value = QUEUES[partition.kind]
        with files.open_input_file(partition.path) as f:
            opened = pq.ParquetFile(f)
            at = opened.schema_arrow.get_field_index("step")
            for group in range(opened.num_row_groups):
                known = opened.metadata.row_group(group).column(at).statistics
                if known is not None and known.has_min_max and (known.max <= partition.after or known.min > partition.upto):
                    continue  # none of its steps is asked for
                rows = opened.read_row_group(group, columns=[key, column, "step"])
                queued = pc.is_null(rows[column]) if value is None else pc.equal(rows[column], value)
                step = rows["step"]
                rows = rows.filter(pc.and_(queued, pc.and_(pc.greater(step, partition.after), pc.less_equal(step, partition.upto))))
                ids = rows[key].cast(pa.string()).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([partition.kind] * len(ids), pa.string()), ids], ["kind", "id"])


class Queued(DataSource):
    """Stream source "queued": (kind, id) of players and matches queued in the tables of a ``Store``, commit by commit."""

    @classmethod
    def name(cls) -> str:
        return "queued"

    def schema(self) -> str:
        return "kind string, id string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return QueuedReader(self.options)


def _answers(store: Store, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written under a name of its own; where it is there as a whole already, it is read."""
    path = f"{store.folder}/_answers/{name}"
    files, at = store.tables._path(f"{path}/_SUCCESS")
    if not files.exists(at):
        make().write.mode("overwrite").parquet(path)
    return store.spark.read.parquet(path)


def take_batch(store: Store, match_ids: Fetch, fetch: Fetch, name: str, rows: DataFrame, number: int, enqueue: bool = True, queue_id: int | None = 420, min_patch: tuple[int, int] = (0, 0), max_attempts: int = 4) -> None:
    """Ask for and store what a batch (kind, id) has queued and is still queued; repeated after its commit, it does nothing."""
    tables = store.tables
    if tables.done(name) >= number:
        return
    path = staged(rows, "queued").inputFiles()
    batch = store.spark.read.schema("kind string, id string").parquet(*path) if path else store.spark.createDataFrame([], "kind string, id string")
    players, matches = (batch.where(F.col("kind") == kind).select(F.col("id").alias(QUEUES[kind][1])).distinct() for kind in QUEUES)
    if tables.done(f"{name}-lists") < number:
        claimed = staged(store.read("crawl_players", players).where("processed_at IS NULL"), "claimed")
        if not claimed.isEmpty():
            listed = _answers(store, f"{name}-{number}-lists", lambda: match_ids(claimed.select("puuid")))
            with tables.together((f"{name}-lists", number)):
                store.take_lists(claimed, listed)
    ids = staged(store.read("crawl_matches", matches).where("state = 'pending'").select("match_id"), "asked")
    if not ids.isEmpty():
        answers = _answers(store, f"{name}-{number}-matches", lambda: fetch(ids))
        with tables.together((name, number)):
            store.take_answers(ids, staged(ingest.answered(answers, queue_id, min_patch), "answers"), enqueue, max_attempts)
    tables._remove([f"{store.folder}/_answers/{name}-{number}-{what}" for what in ("lists", "matches")])


def collecting(store: Store, match_ids: Fetch, fetch: Fetch, checkpoint: str, name: str = "collect", **options) -> DataStreamWriter:
    """A stream, to be started, that collects all that can be reached from what is queued in the store.

    ``match_ids`` and ``fetch`` are those of ``Store.expand`` and ``Store.drain``, ``options`` those of
    the latter.  Failed matches are queued again by their own commit until they are dead; players whose
    list failed stay queued in the table, for ``Store.expand``.  Batches are as large as what one commit
    queued.  One such query for each store.
    """
    store.spark.dataSource.register(Queued)
    stream = store.spark.readStream.format("queued").option("path", store.folder).load()
    return stream.writeStream.queryName(name).foreachBatch(lambda rows, number: take_batch(store, match_ids, fetch, name, rows, number, **options)).option("checkpointLocation", checkpoint)
