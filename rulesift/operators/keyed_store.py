"""A keyed table that grows by appends and is read by few keys: the layout of the response and embedding caches.

Rows of one model lie below ``<path>/<model>``:

* ``log/<batch>``: the rows of one append, as the tasks wrote them;
* ``runs/<run>/data/prefix=<p>``: folded rows, one for each key, sorted by key and partitioned by the first hex digits of the key;
* ``runs/<run>/bloom/prefix=<p>``: a blocked Bloom filter of the run's keys, a row for each 64-bit word;
* ``manifest/<version>``: which batches and runs are live. A new version is renamed into place and the rename fails if
  the version exists, so of two writers one takes the next version and tries again.

``lookup`` reads, of each run, the Bloom words of the asked prefixes, then the data of the prefixes in which some asked key may be; the
unfolded batches are read whole, and ``fold`` keeps them few. Folding writes the batches as a new run, together with all newer
runs that are not much larger, so that there are about log(rows) runs and each row is rewritten about log(rows) times.

Readers that hold a DataFrame keep the files they listed: files are deleted one fold after the one that replaced them.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.session import cut_lineage

FOLD_BATCHES = 8                 # unfolded batches that a reader puts up with
RUN_RATIO = 2                    # a fold takes in every newer run up to so many times its size
ROWS_A_PREFIX = 1 << 16          # a run gets one more hex digit while its prefixes would hold more rows
MAX_DIGITS = 3                   # 4,096 prefixes at most; beyond, a prefix has several files
BYTES_A_FILE = 128 << 20
BITS_A_KEY = 16
BLOOM_BITS = 4                   # bits a key sets, all in one word
KEPT_VERSIONS = 4                # manifests kept behind the current one


class KeyedStore:
    """Rows of ``schema`` for one ``model``; ``key`` is a lower-case hex digest, ``error`` (if a column) marks rows that are no answer."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, model: str):
        self.spark, self.schema, self.key, self.model = spark, schema, key, model
        self.top = path.rstrip("/")
        self.root = f"{self.top}/{quote(model, safe='')}.store"
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifest -------------------------------------------------------------------

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """``{"version", "log": [batch], "runs": [{"name", "rows", "digits", "prefixes"}], "old": [path]}``."""
        for _ in range(100):
            versions = self._versions()
            if not versions:
                return {"version": 0, "log": [], "runs": [], "old": []}
            p = self._path(f"{self.root}/manifest/{versions[-1]:08d}")
            try:
                stream = self._fs.open(p)
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                return json.loads(text) | {"version": versions[-1]}
            except Exception:  # noqa: BLE001 - a newer version has replaced it meanwhile
                if self._fs.exists(p):
                    raise
        raise RuntimeError(f"the manifest of {self.root} keeps changing")

    def _commit(self, change) -> dict:
        """Write ``change(manifest)`` as the next version; tried again when another writer was first."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        for attempt in range(100):
            now = self.manifest()
            new = change(now)
            version = now["version"] + 1
            target = self._path(f"{self.root}/manifest/{version:08d}")
            draft = self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
            out = self._fs.create(draft, True)
            out.write(bytearray(json.dumps({k: v for k, v in new.items() if k != "version"}).encode()))
            out.close()
            try:
                files.rename(draft, target, self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
            except Exception:  # noqa: BLE001 - somebody has this version
                self._fs.delete(draft, False)
                if not self._fs.exists(target):
                    raise
                time.sleep(0.05 * (attempt + 1))
                continue
            for v in self._versions()[:-KEPT_VERSIONS]:
                self._fs.delete(self._path(f"{self.root}/manifest/{v:08d}"), False)
            return new | {"version": version}
        raise RuntimeError(f"no version of {self.root} could be written; too many writers")

    # --- writing --------------------------------------------------------------------

    def append(self, rows: DataFrame) -> str:
        """Store rows of the schema as one batch, visible to readers once it is complete; returns its name."""
        batch = uuid.uuid4().hex
        rows.select(*self.schema.names).write.parquet(f"{self.root}/log/{batch}")
        self._commit(lambda m: m | {"log": [*m["log"], batch]})
        return batch

    def adopt(self) -> None:
        """Take over rows that an earlier release stored as a plain table partitioned by model; done once."""
        old = f"{self.top}/model={quote(self.model, safe=' ')}"
        if not self._versions() and self._fs.exists(self._path(old)):
            self.append(self.spark.read.schema(self.schema).parquet(self.top).where(F.col("model") == self.model))

    def fold(self, least: int = FOLD_BATCHES) -> bool:
        """With at least ``least`` batches, write them and the newer runs up to their size as one run."""
        m = self.manifest()
        if len(m["log"]) < max(least, 1):
            return False
        batches = list(m["log"])
        rows = self._batches(batches)
        n = rows.count()
        taken = []
        for run in reversed(m["runs"]):  # newest first
            if run["rows"] > RUN_RATIO * n:
                break
            taken.append(run)
            n += run["rows"]
        sources = [f"{self.root}/log/{b}" for b in batches] + [f"{self.root}/runs/{r['name']}" for r in taken]
        size = sum(self._fs.getContentSummary(self._path(s)).getLength() for s in sources)
        for run in taken:
            rows = rows.unionByName(self._data(run, run["prefixes"]))
        made = self._write_run(one_row(rows, self.key, self.schema), n, size)
        gone = {r["name"] for r in taken}

        def change(now: dict) -> dict:
            if not set(batches) <= set(now["log"]) or not gone <= {r["name"] for r in now["runs"]}:
                raise RuntimeError(f"another fold of {self.root} was first")
            return {"log": [b for b in now["log"] if b not in batches],
                    "runs": sorted([r for r in now["runs"] if r["name"] not in gone] + [made], key=lambda r: -r["rows"]), "old": sources}

        try:
            now = self._commit(change)
        except RuntimeError:
            self._fs.delete(self._path(f"{self.root}/runs/{made['name']}"), True)
            return False
        for s in m["old"]:  # replaced by the fold before this one
            if s not in now["old"]:
                self._fs.delete(self._path(s), True)
        return True

    def _write_run(self, rows: DataFrame, n: int, size: int) -> dict:
        name = uuid.uuid4().hex
        digits = 0
        while digits < MAX_DIGITS and n > ROWS_A_PREFIX * 16 ** digits:
            digits += 1
        placed = rows.withColumn("prefix", prefix_of(self.key, digits))
        (placed.repartitionByRange(max(1, -(-size // BYTES_A_FILE)), "prefix", self.key).sortWithinPartitions("prefix", self.key)
         .write.partitionBy("prefix").parquet(f"{self.root}/runs/{name}/data"))
        data = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("prefix", T.StringType())])).parquet(f"{self.root}/runs/{name}/data")
        counts = data.groupBy("prefix").count().collect()  # at most 16 ** MAX_DIGITS rows
        words = -(-max((r["count"] for r in counts), default=1) * BITS_A_KEY // 64)
        bits = data.select("prefix", self.key).select("prefix", word_of(self.key, words).alias("word"), mask_of(self.key).alias("mask"))
        (bits.groupBy("prefix", "word").agg(F.bit_or("mask").alias("bits"))
         .write.partitionBy("prefix").parquet(f"{self.root}/runs/{name}/bloom"))
        return {"name": name, "rows": sum(r["count"] for r in counts), "digits": digits, "words": words, "prefixes": sorted(r["prefix"] for r in counts)}

    # --- reading --------------------------------------------------------------------

    def _batches(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/log/{b}" for b in names))

    def _data(self, run: dict, prefixes: list[str]) -> DataFrame:
        """The rows of some prefixes; other folders are not listed."""
        if not prefixes:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/runs/{run['name']}/data/prefix={p}" for p in prefixes))

    def candidates(self, keys: DataFrame, run: dict) -> list[str]:
        """Prefixes of a run in which some key may be stored, by the Bloom words of the asked prefixes."""
        keys = keys.select(self.key, prefix_of(self.key, run["digits"]).alias("prefix"))
        asked = {r["prefix"] for r in keys.select("prefix").distinct().collect()} & set(run["prefixes"])  # bounded by the prefixes
        if not asked:
            return []
        kind = T.StructType([T.StructField("word", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("prefix", T.StringType())])
        folder = f"{self.root}/runs/{run['name']}/bloom"
        bloom = self.spark.read.schema(kind).option("basePath", folder).parquet(*(f"{folder}/prefix={p}" for p in sorted(asked)))
        probe = keys.select("prefix", word_of(self.key, run["words"]).alias("word"), mask_of(self.key).alias("mask"))
        hits = probe.join(bloom, ["prefix", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        return sorted(r["prefix"] for r in hits.select("prefix").distinct().collect())

    def recent(self, keys: DataFrame) -> DataFrame:
        """Rows of the asked keys in batches that are not folded yet."""
        return self._batches(self.manifest()["log"]).join(keys, self.key, "left_semi")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """All stored rows of the asked keys (a key can have several); ``keys`` has distinct keys and is read several times."""
        m = self.manifest()
        found = self._batches(m["log"])
        for run in m["runs"]:  # about log(rows) of them
            found = found.unionByName(self._data(run, self.candidates(keys, run)))
        return found.join(keys, self.key, "left_semi")

    def rows(self) -> DataFrame:
        """The whole table, one row for each key."""
        m = self.manifest()
        found = self._batches(m["log"])
        for run in m["runs"]:
            found = found.unionByName(self._data(run, run["prefixes"]))
        return one_row(found, self.key, self.schema)

    def files(self) -> int:
        """Data files of the live batches and runs."""
        m = self.manifest()
        folders = [f"{self.root}/log/{b}" for b in m["log"]] + [f"{self.root}/runs/{r['name']}/data" for r in m["runs"]]
        return sum(self._count(self._path(f)) for f in folders)

    def _count(self, folder) -> int:
        return sum(self._count(s.getPath()) if s.isDirectory() else s.getPath().getName().startswith("part-") for s in self._fs.listStatus(folder))


def one_row(rows: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """One row for each key, an answer before an error, else the least: the same whatever the order of writing."""
    others = [c for c in schema.names if c != key]
    bad = F.col("error").isNotNull() if "error" in others else F.lit(False)
    return (rows.groupBy(key).agg(F.min(F.struct(bad.alias("_bad"), *others)).alias("_r"))
            .select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in schema.names)))


def prefix_of(key: str, digits: int) -> Column:
    """The partition of a key; the marker keeps numeric-looking prefixes strings."""
    return F.concat(F.lit("x"), F.substring(key, 1, digits)) if digits else F.lit("x")


def word_of(key: str, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("word"), F.col(key)), F.lit(words).cast("long"))


def mask_of(key: str) -> Column:
    h = F.xxhash64(F.lit("mask"), F.col(key))
    mask = F.lit(0).cast("long")
    for i in range(BLOOM_BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def distinct_keys(keyed: DataFrame, key: str) -> DataFrame:
    """The asked keys, once each, as a table that can be read several times."""
    return cut_lineage(keyed.select(key).distinct())
