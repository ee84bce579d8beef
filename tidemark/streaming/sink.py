"""Streams into a bitemporal store: late and revised records become versions, retried batches change nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import IDENTITY, MANDATORY, Store, faults, nearly


def sequenced(rows: DataFrame, stored: DataFrame, payload: list[str], noisy: tuple[str, ...] = ()) -> DataFrame:
    """Records that tell something new, with their versions: what appending them one by one, as fetched, would add to the stored revisions.

    Records and revisions of an identity stand in one line by fetched_at, published_at and payload, revisions first. A
    record whose payload is that of its neighbour before adds nothing: so a record sent again, however late, adds nothing.
    Every other is the next version of its identity, late news too (what differs from what was known when it was fetched):
    versions count arrivals, and the last to arrive is current, as with append.
    """
    both = rows.withColumn("_old", F.lit(0)).unionByName(stored.select(*rows.columns).withColumn("_old", F.lit(1)))
    line = Window.partitionBy(*IDENTITY).orderBy(F.col("fetched_at"), F.col("_old").desc(), F.col("published_at").asc_nulls_first(), *(F.col(c) for c in payload))
    before = F.lag(F.struct(*payload)).over(line)
    df = both.withColumns({"_before": before, "_last": F.max(F.when(F.col("_old") == 1, F.col("version"))).over(Window.partitionBy(*IDENTITY))})
    same = F.lit(True)
    for c in payload:
        was = F.col("_before")[c]
        same = same & (nearly(F.col(c), was) if c in noisy else F.col(c).eqNullSafe(was))
    df = df.withColumn("_new", (F.col("_old") == 0) & (F.col("_before").isNull() | ~same))
    count = F.sum(F.col("_new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("version", (F.coalesce("_last", F.lit(0)) + count).cast(rows.schema["version"].dataType)).where("_new").select(*rows.columns)


class StoreSink:
    """foreachBatch writer of a dataset: `stream.writeStream.foreachBatch(StoreSink(store, name, query)).start()`.

    A batch is judged once, into a folder named by query and batch, its files are moved into the dataset under names that
    follow from both, and a record of the batch ends it. Run again after it was killed, a batch takes up where it stood:
    unjudged it is judged, judged it is not judged anew, moved files stay, and a recorded batch is passed over. Whatever
    was interrupted, the dataset ends as one run would leave it. Readers may see a part of a batch while it is moved.

    Records that break the store's rules go to root/_refused/name with their fault, so that they do not stop the stream.
    One writer a dataset at a time, as Structured Streaming has it.
    """

    def __init__(self, store: Store, name: str, query: str) -> None:
        if name not in store.schemas:
            raise ValueError(f"{name} is not declared")
        self.store, self.name, self.query = store, name, query

    def _at(self, kind: str, batch_id: int) -> str:
        return f"{self.store.root}/_{kind}/{self.name}/{self.query}/{batch_id}"

    def recorded(self, batch_id: int) -> bool:
        fs, at = self.store._fs(self._at("batches", batch_id))
        return fs.exists(at)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.write(batch, batch_id)

    def write(self, batch: DataFrame, batch_id: int) -> bool:
        """Whether this call had anything to do."""
        if self.recorded(batch_id):
            return False
        self.judge(batch, batch_id)
        n = self.publish(batch_id)
        self.record(batch_id, n)
        return True

    def judge(self, batch: DataFrame, batch_id: int) -> None:
        """The new versions of a batch in a folder of its own, complete if it holds _SUCCESS."""
        store, schema = self.store, self.store.schemas[self.name]
        folder = self._at("judged", batch_id)
        fs, at = store._fs(f"{folder}/_SUCCESS")
        if fs.exists(at):
            return
        payload = [c for c in schema.names if c not in MANDATORY]
        rows = faults(batch.select(*schema.names)).persist()
        try:
            rows.where("fault is not null").write.mode("overwrite").parquet(f"{store.root}/_refused/{self.name}/{self.query}-{batch_id}")
            sound = rows.where("fault is null").drop("fault")
            stored = store.touched(self.name, sound)
            fresh = sequenced(sound, stored, payload, store.noisy.get(self.name, ()))
            fresh.withColumns({"_source": F.col("source"), "_year": F.year("as_of")}).write.mode("overwrite").option("compression", "zstd").partitionBy("_source", "_year").parquet(folder)
        finally:
            rows.unpersist()

    def publish(self, batch_id: int) -> int:
        """Move the judged files into the dataset; a file that is there already was moved before. Returns the files of the batch."""
        folder = self._at("judged", batch_id)
        fs, top = self.store._fs(folder)
        path = self.store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files, n = fs.listFiles(top, True), 0
        root = fs.makeQualified(top).toString()
        moves = []
        while files.hasNext():
            at = files.next().getPath()
            if at.getName().endswith(".parquet"):
                part = at.getParent().toString()[len(root) :].strip("/")
                moves.append((at, path(f"{self.store.path(self.name)}/{part}/{self.query}-{batch_id}-{at.getName()}")))
        for at, to in moves:
            n += 1
            fs.mkdirs(to.getParent())
            self.move(fs, at, to)
        return n

    def move(self, fs, at, to) -> None:
        if not fs.exists(to) and not fs.rename(at, to):
            raise OSError(f"{at} could not be moved to {to}")

    def record(self, batch_id: int, files: int) -> None:
        """The mark that ends a batch; then its folder goes."""
        fs, at = self.store._fs(self._at("batches", batch_id))
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"batch": batch_id, "files": files}).encode()))
        out.close()
        _, judged = self.store._fs(self._at("judged", batch_id))
        fs.delete(judged, True)


def appended(rows: DataFrame, noisy: tuple[str, ...] = ()) -> DataFrame:
    """All versions that the records of a table give: what a stream of them, batch by batch as fetched, leaves in a store."""
    payload = [c for c in rows.columns if c not in MANDATORY]
    sound = faults(rows).where("fault is null").drop("fault")
    return sequenced(sound, sound.limit(0), payload, noisy)
