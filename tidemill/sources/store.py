"""A snapshot that grows without being rewritten: what a batch adds is appended, and a manifest tells what counts.

Under one folder:

- keys/: the fingerprints (16 bytes) of all records, by version, in buckets of the fingerprint. The batch
  is dealt to the same buckets and joined there, so the keys of the history are read but not shuffled;
- data/version=<n>/: the records that version n added, with their fingerprints;
- manifest/<n>.json: written last, by a rename. It names the last version that counts, the number of
  records and the last id. What a run that died left behind is above that version, and is replaced.

So a merge reads the history's keys and none of its records, and writes what is new. Ids go on from the
manifest's, so the result equals merge() of records.py where history is what merges have made it (dense
and distinct), and old ids never change. Two writers of the same version: the second fails at the rename."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import FIELDS, RECORD, START_ID, assign_ids, deduplicate, record_fingerprint
from ..scratch import exists, materialise, move_into_place

BUCKETS = 256


class Store:
    def __init__(self, spark: SparkSession, path: str, start: int = START_ID, buckets: int | None = None) -> None:
        """path: a folder on any store; start: the first id; buckets: as many for the life of the folder,
        by default no fewer than the session's shuffle partitions (with fewer, Spark may deal the keys anew)."""
        self.spark, self.path, self.start = spark, path.rstrip("/"), start
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self.manifest().get("buckets") or buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    # ------------------------------------------------------------ manifest

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._jvm.Path(f"{self.path}/{name}"))

    def _delete(self, name: str) -> None:
        self._fs.delete(self._jvm.Path(f"{self.path}/{name}"), True)

    def manifest(self) -> dict[str, int]:
        """The last one: version, records, last_id, buckets; of an empty store version 0."""
        if not self._exists("manifest"):
            return {"version": 0, "records": 0, "last_id": self.start - 1}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jvm.Path(f"{self.path}/manifest"))]
        last = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not last:
            return {"version": 0, "records": 0, "last_id": self.start - 1}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{last}.json", wholetext=True).first()["value"])

    def _commit(self, found: dict[str, int]) -> None:
        fresh, here = (self._jvm.Path(f"{self.path}/manifest/{n}") for n in (f"{uuid.uuid4().hex}.new", f"{found['version']}.json"))
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(found).encode()))
        stream.close()
        if self._fs.exists(here) or not self._fs.rename(fresh, here):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"{self.path}: version {found['version']} was written by another run")

    # ------------------------------------------------------------ tables

    def _keys_table(self) -> str:
        """The session's name of the folder of keys, by which Spark knows its buckets."""
        name = f"tidemill_keys_{hashlib.md5(self.path.encode()).hexdigest()}_{self.buckets}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BINARY, version INT) USING parquet PARTITIONED BY (version) CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/keys'")
        if self.spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive":
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        self.spark.catalog.refreshTable(name)
        return name

    def keys(self) -> DataFrame:
        """fp (binary), version, read by bucket; only what counts."""
        return self.spark.table(self._keys_table()).where(F.col("version") <= self.manifest()["version"])

    def records(self) -> DataFrame:
        """The snapshot: id and the five fields."""
        version = self.manifest()["version"]
        if not version:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*[f"{self.path}/data/version={v}" for v in range(1, version + 1)])

    # ------------------------------------------------------------ merge

    def _new(self, batch: DataFrame) -> DataFrame:
        """Records of the batch (five fields and seq), each once, that the store does not have: row, fp."""
        own = deduplicate(batch.select(*FIELDS[1:], "seq")).select(F.struct(*FIELDS[1:], "seq").alias("row"), F.unhex(record_fingerprint()).alias("fp"))
        return own.join(self.keys().select("fp"), "fp", "left_anti") if self.manifest()["version"] else own

    def merge(self, batch: DataFrame) -> int:
        """Adds a batch (five fields, and seq, its order); returns how many records were new."""
        return self._add(materialise(self._new(batch)), None)  # written, since the numbering reads its input twice

    def append(self, new: DataFrame, token: str) -> int:
        """Adds records (five fields and seq) that are known to be new and different from each other, once for each token
        that names a batch: if the last version has the token, the batch was added before."""
        if self.manifest().get("token") == token:
            return 0
        rows = new.select(F.struct(*FIELDS[1:], "seq").alias("row"), *FIELDS[1:]).select("row", F.unhex(record_fingerprint()).alias("fp"))
        return self._add(materialise(rows), token)

    def _add(self, new: DataFrame, token: str | None) -> int:
        found = self.manifest()
        version = found["version"] + 1
        self._delete(f"data/version={version}")
        self._delete(f"keys/version={version}")
        data = f"{self.path}/data/version={version}"
        numbered = assign_ids(new.select("row.*", "fp"), start=found["last_id"] + 1)
        numbered.select(*FIELDS, "fp").write.option("compression", "zstd").parquet(data)
        added = self.spark.read.schema("fp BINARY").parquet(data)
        self._write_keys(added.select("fp", F.lit(version).alias("version")))
        n = added.count()
        self._commit({"version": version, "records": found["records"] + n, "last_id": found["last_id"] + n, "buckets": self.buckets, "token": token})
        return n

    def _write_keys(self, keys: DataFrame) -> None:
        keys.repartition(self.buckets, "fp").write.insertInto(self._keys_table())  # one file a bucket


def is_store(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path.rstrip('/')}/manifest")


def restart(spark: SparkSession, path: str, batch: DataFrame, start: int = START_ID) -> int:
    """A store of this batch alone takes the place of the one at path, which is whole until then."""
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
    n = Store(spark, fresh, start).merge(batch)
    move_into_place(spark, fresh, path)
    return n
