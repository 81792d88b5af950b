"""A store of keyed rows that a delivery is checked against without reading the store whole.

Rows lie in a Parquet table that is bucketed by key, so a join on the key shuffles the delivery only. A second table
holds Bloom filters: each bucket's keys are spread over a fixed number of bitmaps, and a key sets a few bits in one of
them. A delivery first meets the bitmaps of its keys; what passes is looked up in the buckets it falls into, and files
of other buckets are not opened.
"""

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfold.operators.ingest import ACCEPTED, KEY, classify_import
from tallyfold.session import cut_lineage

#: Bits of one bitmap (what `bitmap_construct_agg` makes), and bits a key sets.
BITMAP_BITS, PROBES = 32768, 4
_FILE_BUCKET = r"_([0-9]+)\."


@dataclass(frozen=True)
class KeyStore:
    """Handle of a store below `path`; make one with `create_store` or `open_store`.

    `buckets` should make buckets of some hundred MB at the size the store will grow to; with `blocks` bitmaps a bucket, a
    bucket's filters stay sharp up to about 3,000 keys a bitmap. Fuller filters let more keys pass to the exact lookup, and the
    result stays the same.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int
    blocks: int

    def _table(self, kind: str, schema: str, keys: tuple[str, ...]) -> str:
        """Name of the external table over a folder, known to this session from the first use on."""
        name = f"key_store_{kind}_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            quoted = ", ".join(f"`{k}`" for k in keys)
            self.spark.sql(f"create table {name} ({schema}) using parquet clustered by ({quoted}) into {self.buckets} buckets location '{self.path}/{kind}'")
        return name

    @property
    def row_table(self) -> str:
        return self._table("rows", self.schema, self.keys)

    @property
    def filter_table(self) -> str:
        return self._table("filters", "bucket int, block int, bits binary", ("bucket", "block"))

    def rows(self) -> DataFrame:
        return self.spark.table(self.row_table)

    def _typed(self, rows: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in StructType.fromDDL(self.schema).fields}
        return rows.select(*[F.col(k).cast(types[k]).alias(k) for k in self.keys])

    def _marked(self, keys: DataFrame) -> DataFrame:
        """Keys with their bucket, the bitmap inside it, and the bits they set there."""
        cols = [F.col(k) for k in self.keys]
        h1, h2 = F.xxhash64(*cols), F.xxhash64(*cols, F.lit(1))
        bits = F.array(*[F.pmod(F.shiftrightunsigned(h1, 1) % (1 << 30) + i * (F.pmod(h2, F.lit(BITMAP_BITS)) * 2 + 1), F.lit(BITMAP_BITS)) for i in range(PROBES)])
        return keys.select("*", F.pmod(F.hash(*cols), F.lit(self.buckets)).cast("int").alias("bucket"),
                           F.pmod(F.xxhash64(*cols, F.lit(2)), F.lit(self.blocks)).cast("int").alias("block"), bits.alias("_bits"))

    def _scan(self, table: str, wanted: set[int]) -> DataFrame:
        """Rows of a table's files of the wanted buckets: files are named by bucket, and the list of files is cut down before any is read."""
        return self.spark.table(table).where(F.regexp_extract(F.col("_metadata.file_name"), _FILE_BUCKET, 1).cast("int").isin(sorted(wanted)))

    def _possible(self, delivered: DataFrame) -> DataFrame:
        """Delivered keys whose bits are all set; the driver sees numbers of buckets only."""
        marked = cut_lineage(self._marked(delivered).withColumn("_file", F.pmod(F.hash("bucket", "block"), F.lit(self.buckets))))
        files = {r[0] for r in marked.select("_file").distinct().collect()}

        def is_set(bit: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("f.bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0

        all_set = reduce(lambda a, b: a & b, [is_set(F.col("k._bits")[i]) for i in range(PROBES)])
        same = (F.col("k.bucket") == F.col("f.bucket")) & (F.col("k.block") == F.col("f.block"))
        found = marked.alias("k").join(self._scan(self.filter_table, files).alias("f"), same & all_set, "left_semi")
        return found.select(*self.keys, "bucket")

    def matching(self, incoming: DataFrame) -> DataFrame:
        """Keys of `incoming` that are stored, each once. Null keys are never stored."""
        delivered = self._typed(incoming).dropna().distinct()
        possible = cut_lineage(self._possible(delivered))
        hit = {r[0] for r in possible.select("bucket").distinct().collect()}
        return possible.select(*self.keys).join(self._scan(self.row_table, hit).select(*self.keys), list(self.keys), "left_semi")

    def classify(self, incoming: DataFrame, order=("file", "line"), dry_run: bool = False) -> DataFrame:
        """`classify_import` against this store."""
        return classify_import(incoming, self.matching(incoming), self.keys, order, dry_run)

    def append(self, rows: DataFrame) -> None:
        """Add rows whose keys are new: filters first, so that a stored key can never be missing from them."""
        rows = rows.select(*StructType.fromDDL(self.schema).names)
        marks = self._marked(self._typed(rows)).select("bucket", "block", F.explode("_bits").alias("_bit"))
        bitmaps = marks.groupBy("bucket", "block").agg(F.bitmap_construct_agg("_bit").alias("bits"))
        bitmaps.repartition(self.buckets, "bucket", "block").write.insertInto(self.filter_table)
        rows.repartition(self.buckets, *self.keys).write.insertInto(self.row_table)

    def append_absent(self, incoming: DataFrame, order=("file", "line")) -> DataFrame:
        """Store the first incoming row of every key that is not stored; returns all rows with their status."""
        judged = cut_lineage(self.classify(incoming, order))
        self.append(judged.where(F.col("status") == ACCEPTED))
        return judged


def create_store(spark: SparkSession, path: str, schema: str, keys=KEY, buckets: int = 64, blocks: int = 8) -> KeyStore:
    """New, empty store; its description lies beside the rows as text."""
    about = {"schema": schema, "keys": list(keys), "buckets": buckets, "blocks": blocks}
    spark.range(1).select(F.lit(json.dumps(about)).alias("value")).coalesce(1).write.text(f"{path}/about")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> KeyStore:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return KeyStore(spark, path, about["schema"], tuple(about["keys"]), about["buckets"], about["blocks"])
