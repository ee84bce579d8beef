"""A registry of experiments: one record a configuration, named by its digest, written once."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Losses that differ by no more are the same: a fixed value.
TIE = 1e-12


class Registry:
    """Records root/runs/<sha256 of the configuration>/record.json.

    A record is made by one writer: the first to link (a local or mounted folder) or to create (any store whose creation
    is exclusive, such as hdfs) the file wins, and others get the record that stands. A record is never changed; the same
    configuration with another result is an error to its writer.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def digest(config: Mapping[str, object]) -> str:
        return hashlib.sha256(_text(config).encode()).hexdigest()

    def record(self, config: Mapping[str, object], result: Mapping[str, object], as_of: str) -> tuple[str, bool]:
        """(digest, whether this call wrote it)."""
        name = self.digest(config)
        folder = f"{self.root}/runs/{name}"
        text = _text({"config": config, "config_sha256": name, "result": result, "result_sha256": self.digest(result), "as_of": as_of})
        won = self._exclusive(folder, text)
        stands = json.loads(self._read(f"{folder}/record.json"))
        if stands["result_sha256"] != self.digest(result):
            raise ValueError(f"{name} is recorded with another result")
        return name, won

    def _exclusive(self, folder: str, text: str) -> bool:
        local = re.sub(r"^file:/+", "/", folder)
        if local.startswith("/"):
            os.makedirs(local, exist_ok=True)
            early = f"{local}/.{uuid.uuid4().hex}"
            with open(early, "x") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(early, f"{local}/record.json")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(early)
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/record.json")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = fs.create(at, False)
        except Exception:  # noqa: BLE001  whatever the store raises, the record stands if its file does
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def load(self, metrics: tuple[str, ...] = ("sharpe",)) -> DataFrame:
        """(config_sha256, family, as_of, config, metrics..., sound) of every record; sound: the configuration has the digest that names it."""
        kind = ", ".join(f"{m}:double" for m in metrics)
        raw = self.spark.read.text(f"{self.root}/runs/*/record.json", wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"/runs/([0-9a-f]{64})/", 1).alias("named"))
        got = raw.select("named", F.get_json_object("value", "$.config").alias("config"), F.get_json_object("value", "$.config.family").alias("family"), F.get_json_object("value", "$.as_of").alias("as_of"), F.get_json_object("value", "$.config_sha256").alias("config_sha256"), F.from_json(F.get_json_object("value", "$.result"), f"struct<{kind}>").alias("r"))
        return got.select("config_sha256", "family", "as_of", "config", *(F.col(f"r.{m}").alias(m) for m in metrics), (F.col("named") == F.col("config_sha256")).alias("sound"))

    def trials(self, extra: int = 0, metric: str = "sharpe") -> DataFrame:
        """(n_trials, variance) of a metric over all records, with `extra` trials made elsewhere."""
        return self.load((metric,)).agg((F.count("*") + extra).alias("n_trials"), F.var_samp(metric).alias("variance"))


def _text(x: Mapping[str, object]) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def chosen(candidates: DataFrame, by: tuple[str, ...] = (), families: tuple[str, ...] = ("elasticnet", "lightgbm")) -> DataFrame:
    """The one candidate of each group, of (brier_score, log_loss, family, run_sha256), by a total order.

    Least Brier score, then least log loss, each within TIE of the least; then the family's place in the list (others
    last), then the least digest. A group in which a candidate has no score is undecided: it has no row, as none may win by
    elimination. Candidates of a group are few; without `by` they are one group.
    """
    group = [F.col(c) for c in by] or [F.lit(0)]
    over = Window.partitionBy(*group)
    df = candidates.withColumn("__all", F.min((F.col("brier_score").isNotNull() & F.col("log_loss").isNotNull()).cast("int")).over(over)).where("__all = 1")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, families)), F.col("family")), F.lit(0))
    df = df.withColumn("__rank", F.when(rank == 0, len(families) + 1).otherwise(rank))
    for c, tie in (("brier_score", TIE), ("log_loss", TIE), ("__rank", 0), ("run_sha256", None)):
        least = df.withColumn("__least", F.min(c).over(over))
        df = least.where(F.col(c) == F.col("__least") if tie is None else F.col(c) <= F.col("__least") + tie).drop("__least")
    return df.select(*candidates.columns).dropDuplicates([*by, "run_sha256"])
