"""Exact deduplication as a stream with state: of equal texts the row with the largest id stays.

A streaming query reads the files of a table, each once, in batches. Its state is keyed by the digest of a text and kept on
disk (RocksDB), without a watermark, so that no key ever expires: for each digest the largest id, where the text with that
id is (file and row, the locator), and how many rows had it. Rows of one digest are counted where they are read before
they are dealt, so a text that a third of all rows have is a few rows for its key. The keys that a batch changes are
written as one folder, which a batch that is played again after a failure overwrites; started again on the same folder,
the stream takes what files have come since.

Digests that more than one row has are hits, and on hits all bytes count: their texts are read again and compared whole,
with the retained ones among them. Which rows those are is told where they are read, by a bitmap of a fixed size (BITS);
what it lets through by chance changes nothing. Where the texts of a digest differ, its rows are grouped by their bytes.

A null text counts as empty. Rows without an id count as the smallest; of rows with one id and one text, the last in
(file, row) stays. An empty table gives no rows. Texts of any length are compared whole, by Spark's own operators. Columns
other than the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import removed, shared_folder, written

#: Bits of the map of hits (1 MB), and batches that the files of a table make at most.
BITS, BATCHES = 1 << 23, 4
#: State on disk; its many small stores take the space that they fill, not 4 MB ahead each.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _on_disk(spark: SparkSession):
    """Queries started here keep their state in RocksDB; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ExactDedup:
    """Keeps its state, and what each batch changed, in `folder`, which executors and the driver share."""

    def __init__(self, spark: SparkSession, path: str, folder: str, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256):
        self.spark, self.path, self.folder, self.digest = spark, path, folder, digest
        whole = spark.read.parquet(path).schema
        self.schema = StructType([whole[id_column], whole[text_column]])
        self.id, self.text = F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")

    def rows(self, table: DataFrame) -> DataFrame:
        where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return table.select(self.id, self.text, where.alias("locator")).withColumn("digest", self.digest(F.col("text")))

    def table(self) -> DataFrame:
        return self.rows(self.spark.read.schema(self.schema).parquet(self.path))

    def take(self, files: int | None = None) -> ExactDedup:
        """Reads the files that are new, so many in a batch."""
        spark, out = self.spark, f"{self.folder}/batches"
        files = files or -(-len(spark.read.schema(self.schema).parquet(self.path).inputFiles()) // BATCHES) or 1
        last = PurePosixPath(self.path).name
        glob = f"{self.path[:-len(last)]}{last[:-1]}[{last[-1]}]"  # a pattern may stand for a file as for a folder
        stream = self.rows(spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(glob))
        seen = stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keeper"), F.count("*").alias("n"))
        # the first folder gives the others a schema where no batch comes
        spark.createDataFrame([], seen.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

        def put(changed: DataFrame, number: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out}/batch={number}")

        with _on_disk(spark):
            query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def groups(self) -> DataFrame:
        """(digest, keeper, n) as the last batch that changed each digest left it."""
        return self.spark.read.parquet(f"{self.folder}/batches").groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("n").alias("n"))

    def differing(self, groups: DataFrame) -> DataFrame:
        """Digests of hits whose texts aren't all the same bytes."""
        place = F.pmod(F.xxhash64("digest"), F.lit(BITS)) + 1
        bits = groups.where("n > 1").select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
        rows = self.table().select("digest", "text", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        byte = F.conv(F.hex(F.substring("map", F.expr("CAST(bit DIV 8 + 1 AS int)"), F.lit(1))), 16, 10).cast("long")
        # as many rows as the map has pages: BITS / 32768 of 4 kB
        hits = rows.join(F.broadcast(bits), "bucket").where(F.getbit(byte, F.expr("CAST(bit % 8 AS int)")) == 1)
        return hits.groupBy("digest", "text").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")

    def result(self) -> DataFrame:
        """Each row of the table: id, keep_id, group_size, kept, digest, and the locator of the row that stays."""
        groups, rows = written(self.groups()), self.table()
        odd = written(self.differing(groups))
        found = rows.drop("text").join(groups, "digest")
        if not odd.isEmpty():
            texts = rows.join(odd, "digest", "left_semi")
            exact = texts.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("keeper"), F.count("*").alias("n"))
            found = found.join(odd, "digest", "left_anti").unionByName(texts.join(exact, ["digest", "text"]).drop("text"))
        return found.select("id", F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("keeper.locator")).alias("kept"), "digest", F.col("keeper.locator").alias("keep_locator"))


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files: int | None = None) -> DataFrame:
    """The whole table at `path` in one run, from an empty state, which goes at the end."""
    folder = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    out = ExactDedup(spark, path, folder, digest=digest).take(files).result()
    removed(spark, folder)
    return out


def op11_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet").select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
