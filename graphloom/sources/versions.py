"""Tables that change as a whole: parts as files, and a list of the parts that hold, which is put in place last.

A commit writes the parts that change to folders of its own and then one small file, the
list of all parts with their folders. Readers follow the newest list. What a failed commit
has written is never listed, and a commit that is repeated changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """The parts of a table, or several tables as parts, below ``path``; ``schemas`` names the schema of each kind of part, by the part's name up to ``=``."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        """The committed versions."""
        at = self._at("lists")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def parts(self, number: int | None = None) -> dict[str, str]:
        """Folder of each part in a version, the newest by default."""
        known = self.numbers()
        if not known:
            return {}
        line = self.spark.read.text(f"{self.path}/lists/{known[-1] if number is None else number}").first()
        return json.loads(line.value)

    def read(self, part: str, number: int | None = None) -> DataFrame:
        """A part; empty where it isn't listed."""
        folder = self.parts(number).get(part)
        schema = self.schemas[part.split("=")[0]]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def read_all(self, kind: str, number: int | None = None) -> DataFrame:
        """All parts of a kind together, in one scan."""
        folders = [f"{self.path}/{f}" for p, f in sorted(self.parts(number).items()) if p.split("=")[0] == kind]
        return self.spark.read.schema(self.schemas[kind]).parquet(*folders) if folders else self.spark.createDataFrame([], self.schemas[kind])

    def commit(self, number: int, changed: dict[str, DataFrame | None]) -> bool:
        """Write the parts in ``changed`` in their order (``None`` takes one out of the list) and list them as version ``number``; whether it was new."""
        known = self.numbers()
        if known and number <= known[-1]:
            return False
        now = self.parts()
        for part, df in changed.items():
            if df is None:
                now.pop(part, None)
                continue
            now[part] = f"parts/{number}/{part.replace('=', '_')}"
            df.write.mode("overwrite").parquet(f"{self.path}/{now[part]}")
        out = self._fs.create(self._at(f"making/{number}"), True)
        out.write(bytearray((json.dumps(now, sort_keys=True) + "\n").encode()))
        out.close()
        self._fs.mkdirs(self._at("lists"))
        if not self._fs.rename(self._at(f"making/{number}"), self._at(f"lists/{number}")):
            raise RuntimeError(f"version {number} was listed by someone else")
        return True

    def forget(self, keep: int = 2) -> None:
        """Delete the lists before the newest ``keep`` and the folders that no list names any more."""
        known = self.numbers()
        for n in known[:-keep]:
            self._fs.delete(self._at(f"lists/{n}"), False)
        named = {f for n in known[-keep:] for f in self.parts(n).values()}
        if self._fs.exists(self._at("parts")):
            for version in self._fs.listStatus(self._at("parts")):
                for f in self._fs.listStatus(version.getPath()):
                    if f"parts/{version.getPath().getName()}/{f.getPath().getName()}" not in named and int(version.getPath().getName()) <= known[-1]:
                        self._fs.delete(f.getPath(), True)


def replace_documents_everywhere(tables: Versions, number: int, gone: DataFrame, fresh: dict[str, DataFrame], order: list[str]) -> bool:
    """Take the documents in ``gone`` (``document_id``) out of all tables in ``order`` and put ``fresh`` rows in; all of it or, when a table fails, nothing."""
    ids = gone.select("document_id").distinct()
    changed = {}
    for name in order:
        left = tables.read(name).join(ids, "document_id", "left_anti")
        changed[name] = left.unionByName(fresh[name].select(*left.columns)) if name in fresh else left
    return tables.commit(number, changed)


def merge_counts(path: str, shards: int = 32) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: adds the changes of a micro-batch (``user_id, kb_id, normalized_text, entity_type, change``) to the counts below ``path``.

    Only the shards that a batch touches are written anew. A batch that comes again changes
    nothing, and identities whose count is zero are gone.
    """
    key = ["user_id", "kb_id", "normalized_text", "entity_type"]

    def run(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, path, {"counts": COUNTS})
        if table.numbers() and number <= table.numbers()[-1]:
            return
        change = batch.groupBy(*key).agg(F.sum("change").cast("long").alias("mention_count")).withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")).persist()
        try:
            touched = sorted(r.shard for r in change.select("shard").distinct().collect())  # shards at most
            both = {}
            for s in touched:
                old = table.read(f"counts={s}")
                new = old.unionByName(change.where(F.col("shard") == s).drop("shard")).groupBy(*key).agg(F.sum("mention_count").alias("mention_count"))
                both[f"counts={s}"] = new.where("mention_count <> 0")
            table.commit(number, both)
        finally:
            change.unpersist()

    return run


COUNTS = "user_id string, kb_id string, normalized_text string, entity_type string, mention_count long"
