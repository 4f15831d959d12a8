"""An ordered key/value store: buckets of binary keys in byte order, nested by path, with transactions.

Operators work on a view (bucket, key, value): bucket is a path with '/' between, key and value are binary. Store
keeps one on disk as a log of versions, each a Parquet folder of puts and deletes; the view is the last entry of
each key. Readers pin a version, one writer at a time commits the next.
"""

from __future__ import annotations

import json
import threading
import uuid
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.sources.storage import Files

MAX_KEY, MAX_VALUE = 32_768, 2**31 - 2
SCHEMA = "bucket string, key binary, value binary"
_LOG = "bucket string, key binary, value binary, deleted boolean, seq long"


class KeyValueError(ValueError):
    pass


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _lit(x: bytes | str) -> Column:
    return F.lit(bytearray(_bytes(x)))


def in_bucket(view: DataFrame, bucket: str, nested: bool = False) -> DataFrame:
    """The pairs of a bucket, with those of the buckets below it if nested."""
    own = F.col("bucket") == bucket
    return view.where(own | F.col("bucket").startswith(bucket + "/") if nested else own)


def get(view: DataFrame, bucket: str, key: bytes | str) -> DataFrame:
    return in_bucket(view, bucket).where(F.col("key") == _lit(key))


def has(view: DataFrame, bucket: str, key: bytes | str) -> bool:
    return not get(view, bucket, key).isEmpty()


def scan(view: DataFrame, bucket: str) -> DataFrame:
    """All pairs in the order of their keys."""
    return in_bucket(view, bucket).orderBy("key")


def prefix(view: DataFrame, bucket: str, start: bytes | str) -> DataFrame:
    return in_bucket(view, bucket).where(F.startswith("key", _lit(start))).orderBy("key")


def between(view: DataFrame, bucket: str, low: bytes | str, high: bytes | str) -> DataFrame:
    """Keys from low to high, both included."""
    return in_bucket(view, bucket).where((F.col("key") >= _lit(low)) & (F.col("key") <= _lit(high))).orderBy("key")


def seek(view: DataFrame, bucket: str, key: bytes | str) -> DataFrame:
    """The first pair whose key is not less than key."""
    return in_bucket(view, bucket).where(F.col("key") >= _lit(key)).orderBy("key").limit(1)


def after(view: DataFrame, bucket: str, key: bytes | str) -> DataFrame:
    """The first pair whose key is greater than key."""
    return in_bucket(view, bucket).where(F.col("key") > _lit(key)).orderBy("key").limit(1)


def before(view: DataFrame, bucket: str, key: bytes | str) -> DataFrame:
    return in_bucket(view, bucket).where(F.col("key") < _lit(key)).orderBy(F.desc("key")).limit(1)


def first_last(view: DataFrame) -> DataFrame:
    """(bucket, first, last): least and greatest key of each bucket."""
    return view.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last"))


def neighbours(view: DataFrame) -> DataFrame:
    """Each pair with the keys before and after it in its bucket."""
    over = Window.partitionBy("bucket").orderBy("key")
    return view.withColumns({"previous": F.lag("key").over(over), "next": F.lead("key").over(over)})


def statistics(view: DataFrame) -> DataFrame:
    """(bucket, keys, key_bytes, value_bytes) of each bucket."""
    return view.groupBy("bucket").agg(F.count("*").alias("keys"), F.sum(F.length("key")).cast("bigint").alias("key_bytes"), F.sum(F.length("value")).cast("bigint").alias("value_bytes"))


def totals(view: DataFrame) -> DataFrame:
    """(buckets, pairs) of all."""
    return view.agg(F.count_distinct("bucket").alias("buckets"), F.count("*").alias("pairs"))


def sequenced(rows: DataFrame, bucket: str, order_by: str, start: int = 0) -> DataFrame:
    """rows with seq: the bucket's counter, from start + 1 on, in the order of order_by.

    The counter of one bucket is one sequence; several buckets (a column) count side by side.
    """
    over = Window.partitionBy(bucket).orderBy(order_by)
    return rows.withColumn("seq", (F.row_number().over(over) + start).cast("bigint"))


def latest(log: DataFrame) -> DataFrame:
    """(bucket, key, value): of each key the entry of the greatest seq, if that isn't a deletion."""
    last = log.groupBy("bucket", "key").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("e"))
    return last.where("not e.deleted").select("bucket", "key", "e.value")


def problems(view: DataFrame) -> DataFrame:
    """Pairs that no store should have: null or empty or repeated keys, keys or values that are too long."""
    own = view.groupBy("bucket", "key").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("v"))
    return own.where((F.col("n") > 1) | F.col("key").isNull() | (F.length("key") == 0) | (F.length("key") > MAX_KEY) | (F.col("v") > MAX_VALUE) | F.col("v").isNull())


@dataclass
class Transaction:
    """Collects puts and deletes; they are seen when it commits, or never."""

    store: Store
    version: int
    writable: bool
    entries: list[tuple] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)
    buckets: dict[str, int] = field(default_factory=dict)
    hooks: list = field(default_factory=list)
    done: bool = False

    def __post_init__(self):
        self.buckets = dict(self.store._meta(self.version)["buckets"])

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.done:
            self.rollback() if kind or not self.writable else self.commit()

    def _own(self, bucket: str, write: bool = False) -> None:
        if self.done:
            raise KeyValueError("the transaction is over")
        if write and not self.writable:
            raise KeyValueError("the transaction only reads")
        if bucket not in self.buckets:
            raise KeyValueError(f"there is no bucket {bucket}")

    def _clash(self, bucket: str, key: bytes) -> None:
        if f"{bucket}/{key.decode('utf-8', 'replace')}" in self.buckets:
            raise KeyValueError("the key is that of a bucket")

    def put(self, bucket: str, key: bytes | str, value: bytes | str) -> None:
        self._own(bucket, True)
        k, v = _bytes(key), _bytes(value)
        if not k:
            raise KeyValueError("a key is needed")
        if len(k) > MAX_KEY or len(v) > MAX_VALUE:
            raise KeyValueError("the key or the value is too long")
        self._clash(bucket, k)
        self.entries.append((bucket, k, v, False))

    def put_json(self, bucket: str, key: bytes | str, value: object) -> None:
        self.put(bucket, key, json.dumps(value, ensure_ascii=False))

    def delete(self, bucket: str, key: bytes | str) -> None:
        """An absent key makes no difference; that of a bucket is an error."""
        self._own(bucket, True)
        self._clash(bucket, _bytes(key))
        self.entries.append((bucket, _bytes(key), None, True))

    def put_all(self, bucket: str, pairs: DataFrame) -> None:
        """Many pairs (key, value) at once, from a table; of a repeated key any one value stays. They count after the single puts before."""
        self._own(bucket, True)
        kv = pairs.select(F.lit(bucket).alias("bucket"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        if not problems(kv.dropDuplicates(["key"])).isEmpty():
            raise KeyValueError("there are null, empty or too long keys or values")
        self.frames.append(kv.withColumns({"deleted": F.lit(False), "seq": F.lit(len(self.entries)).cast("bigint")}))
        self.entries.append(None)

    def delete_all(self, keys: DataFrame) -> None:
        """Many (bucket, key) at once, from a table; absent keys make no difference. They count after the single puts before."""
        if self.done or not self.writable:
            raise KeyValueError("the transaction is over or only reads")
        own = keys.select("bucket", F.col("key").cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"))
        self.frames.append(own.withColumns({"deleted": F.lit(True), "seq": F.lit(len(self.entries)).cast("bigint")}))
        self.entries.append(None)

    def create_bucket(self, bucket: str) -> None:
        self._creatable(bucket)
        if bucket in self.buckets:
            raise KeyValueError(f"bucket {bucket} is there already")
        self.buckets[bucket] = 0

    def create_bucket_if_absent(self, bucket: str) -> None:
        self._creatable(bucket)
        self.buckets.setdefault(bucket, 0)

    def _creatable(self, bucket: str) -> None:
        if self.done or not self.writable:
            raise KeyValueError("the transaction is over or only reads")
        if not bucket or not bucket.split("/")[-1]:
            raise KeyValueError("a bucket needs a name")
        parent, _, name = bucket.rpartition("/")
        if parent:
            self._own(parent)
            if has(self.view(), parent, name):
                raise KeyValueError("the name is that of a key")

    def delete_bucket(self, bucket: str) -> None:
        """The bucket goes with all below it."""
        self._own(bucket, True)
        for b in [b for b in self.buckets if b == bucket or b.startswith(bucket + "/")]:
            del self.buckets[b]
        self.frames.append(in_bucket(self.view(), bucket, nested=True).select("bucket", "key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted"), F.lit(len(self.entries)).cast("bigint").alias("seq")))
        self.entries.append(None)

    def sequence(self, bucket: str) -> int:
        self._own(bucket)
        return self.buckets[bucket]

    def next_sequence(self, bucket: str) -> int:
        self._own(bucket, True)
        self.buckets[bucket] += 1
        return self.buckets[bucket]

    def on_commit(self, hook) -> None:
        self.hooks.append(hook)

    def _pending(self) -> DataFrame:
        rows = [(e[0], bytearray(e[1]), None if e[2] is None else bytearray(e[2]), e[3], i) for i, e in enumerate(self.entries) if e is not None]
        out = self.store.spark.createDataFrame(rows, _LOG)
        for f in self.frames:
            out = out.unionByName(f)
        return out

    def view(self) -> DataFrame:
        """What this transaction sees: the version that it began on, and its own changes."""
        base = self.store.view(self.version)
        if not self.entries:
            return base
        own = self._pending()
        return latest(base.withColumns({"deleted": F.lit(False), "seq": F.lit(-1).cast("bigint")}).unionByName(own))

    def commit(self) -> int:
        if self.done or not self.writable:
            raise KeyValueError("the transaction is over or only reads")
        self.done = True
        try:
            number = self.store._commit(self)
        finally:
            self.store._lock.release()
        for hook in self.hooks:
            hook()
        return number

    def rollback(self) -> None:
        if not self.done:
            self.done = True
            if self.writable:
                self.store._lock.release()


@dataclass
class Store:
    spark: SparkSession
    path: str

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self.files = Files(self.spark, self.path)
        self._lock = threading.Lock()
        self._calls: list[tuple] = []
        if not self.versions():
            self.files.write_new("versions/00000000.json", json.dumps({"number": 0, "logs": [], "buckets": {}}))

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def _meta(self, number: int | None = None) -> dict:
        return json.loads(self.files.read(f"versions/{self.versions()[-1] if number is None else number:08d}.json"))

    def view(self, number: int | None = None) -> DataFrame:
        """(bucket, key, value) as of a version, the last one by default."""
        logs = self._meta(number)["logs"]
        if not logs:
            return self.spark.createDataFrame([], SCHEMA)
        return latest(self.spark.read.schema(_LOG).parquet(*[f"{self.path}/log/{name}" for name in logs]))

    def begin(self, writable: bool = False) -> Transaction:
        """A writer waits for the one before it; readers never wait, and see the version that they began on."""
        if writable:
            self._lock.acquire()
        return Transaction(self, self.versions()[-1], writable)

    def update(self) -> Transaction:
        return self.begin(True)

    def read(self) -> Transaction:
        return self.begin(False)

    def _commit(self, tx: Transaction) -> int:
        meta = self._meta(tx.version)
        logs, number = list(meta["logs"]), tx.version + 1
        if tx.entries:
            name = uuid.uuid4().hex
            # entries of later versions count after all of earlier ones
            tx._pending().withColumn("seq", F.col("seq") + F.lit(number << 40)).write.parquet(f"{self.path}/log/{name}")
            logs.append(name)
        if not self.files.write_new(f"versions/{number:08d}.json", json.dumps({"number": number, "logs": logs, "buckets": tx.buckets})):
            raise KeyValueError(f"version {number} is there already: another process writes")
        return number

    def batch(self, call) -> Future:
        """Puts off call(transaction); flush() runs all that wait in one transaction."""
        out: Future = Future()
        self._calls.append((call, out))
        if len(self._calls) >= 1000:
            self.flush()
        return out

    def flush(self) -> None:
        """One commit for all calls that wait. One that fails is left out and tried alone, and its error is its own."""
        calls, self._calls = self._calls, []
        while calls:
            failed = None
            tx = self.update()
            for i, (call, _) in enumerate(calls):
                try:
                    call(tx)
                except Exception:
                    failed = i
                    break
            if failed is None:
                tx.commit()
                for _, out in calls:
                    out.set_result(None)
                return
            tx.rollback()
            call, out = calls.pop(failed)
            try:
                with self.update() as alone:
                    call(alone)
                out.set_result(None)
            except Exception as e:
                out.set_exception(e)

    def compact(self) -> int:
        """One log of live pairs in the place of all; older versions keep theirs."""
        with self._lock:
            meta = self._meta()
            name, number = uuid.uuid4().hex, meta["number"] + 1
            self.view().withColumns({"deleted": F.lit(False), "seq": F.lit(number << 40)}).select("bucket", "key", "value", "deleted", "seq").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.parquet(f"{self.path}/log/{name}")
            if not self.files.write_new(f"versions/{number:08d}.json", json.dumps({"number": number, "logs": [name], "buckets": meta["buckets"]})):
                raise KeyValueError(f"version {number} is there already: another process writes")
        return number

    def backup(self, to: str, number: int | None = None) -> None:
        """A store at to that holds what this one holds as of a version."""
        meta = self._meta(number)
        for name in meta["logs"]:
            self.files.copy(f"log/{name}", f"{to}/log/{name}")
        Files(self.spark, to).write_new(f"versions/{meta['number']:08d}.json", json.dumps(meta))

    def describe(self) -> str:
        """Buckets and their pairs, and what is wrong with them, in words."""
        by = {r.bucket: r for r in statistics(self.view()).collect()}
        lines = [f"{b}: {by[b].keys if b in by else 0} keys" for b in sorted(self._meta()["buckets"])]
        bad = problems(self.view()).count()
        return "\n".join([*lines, "OK" if not bad else f"{bad} bad keys"])
