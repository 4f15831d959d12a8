"""A versioned document table of immutable segments.

Each commit writes a manifest, versions/<n>.json, which names the mapping, the segments, the tombstone files and
the next document id. Readers pin a version; a writer that finds its number taken starts over. Segments are
Parquet folders with _docid and the mapped fields. An upsert appends rows and tombstones of the ids that they replace, so neither
rewrites anything, and what is live is one anti-join.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.types import FieldType, Mapping, MappingError
from lodeseek.operators.postings import postings, read_postings, write_postings
from lodeseek.sources.storage import Files

#: Segments of fewer rows are merged.
SMALL = 1_000_000


class Conflict(RuntimeError):
    """Another writer has committed in between."""


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int
    first: int
    last: int
    #: Its fields, which have no null texts, and the least and greatest key.
    fields: tuple[str, ...] = ()
    low: str = ""
    high: str = ""


@dataclass(frozen=True)
class Version:
    number: int
    mapping: str
    segments: tuple[Segment, ...] = ()
    tombstones: tuple[str, ...] = ()
    next_id: int = 0
    #: Documents ever added, deleted ones too.
    added: int = 0
    #: The last streaming batch that is in, by stream.
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Version:
        x = json.loads(text)
        return cls(**x | {"segments": tuple(Segment(**s | {"fields": tuple(s["fields"])}) for s in x["segments"]), "tombstones": tuple(x["tombstones"])})

    def has(self, batch: str | None) -> bool:
        """batch: <stream>-<number>; numbers of a stream go up."""
        return batch is not None and int(batch.rpartition("-")[2]) <= self.batches.get(batch.rpartition("-")[0], -1)

    def with_batch(self, batch: str | None) -> dict[str, int]:
        return self.batches if batch is None else self.batches | {batch.rpartition("-")[0]: int(batch.rpartition("-")[2])}


@dataclass
class Table:
    spark: SparkSession
    path: str
    pinned: int | None = None
    hooks: list = field(default_factory=list)

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self.files = Files(self.spark, self.path)

    # -- versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, mapping: Mapping) -> Table:
        """A new table. The mapping must have a primary key; a table that is there already is an error."""
        if not mapping.primary_key:
            raise MappingError("a table needs a primary key")
        out = cls(spark, path)
        if not out.files.write_new("versions/00000000.json", Version(0, mapping.to_json()).to_json()):
            raise MappingError(f"there is a table at {path} already")
        return out

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self, number: int | None = None) -> Version:
        number = self.pinned if number is None else number
        there = self.versions()
        if not there:
            raise LookupError(f"there is no table at {self.path}")
        return Version.from_json(self.files.read(f"versions/{there[-1] if number is None else number:08d}.json"))

    def at(self, number: int) -> Table:
        """The table as of a version."""
        return Table(self.spark, self.path, number)

    def mapping(self) -> Mapping:
        return Mapping.from_json(self.version().mapping)

    def _commit(self, base: Version, **changes) -> Version:
        new = replace(base, number=base.number + 1, **changes)
        if not self.files.write_new(f"versions/{new.number:08d}.json", new.to_json()):
            raise Conflict(f"version {new.number} is there already")
        for hook in self.hooks:
            hook(new)
        return new

    def on_commit(self, hook) -> None:
        """hook(version) is called after each commit of this object."""
        self.hooks.append(hook)

    # -- reading

    def _schema(self, mapping: Mapping) -> T.StructType:
        return T.StructType([T.StructField("_docid", T.LongType()), *mapping.schema().fields])

    def _segments(self, v: Version, segments: tuple[Segment, ...]) -> DataFrame:
        """Rows of segments. Those that have all fields are read as they are, so that filters go down to their files."""
        mapping = Mapping.from_json(v.mapping)
        schema = self._schema(mapping)
        if not segments:
            return self.spark.createDataFrame([], schema)
        whole = [s for s in segments if set(mapping.fields) <= set(s.fields)]
        parts = []
        for some in (whole, [s for s in segments if s not in whole]):
            if some:
                df = self.spark.read.schema(schema).parquet(*[f"{self.path}/segments/{s.name}" for s in some])
                # segments from before a field was added lack it: text is empty there, numbers and dates are missing
                lacks = {f for f, k in mapping.fields.items() if k not in (FieldType.NUMBER, FieldType.DATE) and any(f not in s.fields for s in some)}
                parts.append(df.select("_docid", *[F.coalesce(F.col(f), F.lit("")).alias(f) if f in lacks else F.col(f) for f in mapping.fields]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def everything(self) -> DataFrame:
        """All rows, deleted ones too."""
        v = self.version()
        return self._segments(v, v.segments)

    def tombstones(self) -> DataFrame:
        """(_docid) of the deleted rows."""
        v = self.version()
        if not v.tombstones:
            return self.spark.createDataFrame([], "_docid long")
        return self.spark.read.schema("_docid long").parquet(*[f"{self.path}/tombstones/{n}" for n in v.tombstones]).distinct()

    def rows(self) -> DataFrame:
        """The live rows."""
        return self._live(self.version(), self.version().segments)

    def _live(self, v: Version, segments: tuple[Segment, ...]) -> DataFrame:
        df = self._segments(v, segments)
        return df.join(self.at(v.number).tombstones(), "_docid", "left_anti") if v.tombstones else df

    def _keyed(self, v: Version, low: str, high: str) -> DataFrame:
        """(_docid, key) of the live rows in the segments whose keys can lie between low and high."""
        pk = Mapping.from_json(v.mapping).primary_key
        near = tuple(s for s in v.segments if not s.fields or s.low <= high and s.high >= low)
        return self._live(v, near).where(F.col(pk).between(low, high)).select("_docid", pk)

    def max_doc(self) -> int:
        return self.version().added

    # -- writing

    def _staged(self, rows: DataFrame, mapping: Mapping, base: int) -> Segment | None:
        """Writes rows as a segment. Ids go up in the order of the input's partitions and rows, with gaps; they are fixed by being written."""
        name = uuid.uuid4().hex
        missing = [f for f in mapping.fields if f not in rows.columns]
        if mapping.primary_key in missing:
            raise MappingError("rows need the primary key")
        kinds = mapping.fields
        own = lambda f, t: (F.col(f) if f in rows.columns else F.lit(None)).cast(t.dataType)
        full = lambda f, t: own(f, t) if kinds[f] in (FieldType.NUMBER, FieldType.DATE) else F.coalesce(own(f, t), F.lit(""))
        filled = rows.select((F.lit(base) + F.monotonically_increasing_id()).alias("_docid"), *[full(f, t).alias(f) for f, t in zip(kinds, mapping.schema())])
        # a key is looked for in the row groups whose filter has it
        filled.write.option(f"parquet.bloom.filter.enabled#{mapping.primary_key}", "true").parquet(f"{self.path}/segments/{name}")
        return self._known(name, mapping)

    def _known(self, name: str, mapping: Mapping) -> Segment | None:
        pk = F.col(mapping.primary_key)
        n, first, last, low, high = self.spark.read.parquet(f"{self.path}/segments/{name}").agg(F.count("*"), F.min("_docid"), F.max("_docid"), F.min(pk), F.max(pk)).first()
        return Segment(name, n, first, last, tuple(mapping.fields), low, high) if n else None

    def add(self, rows: DataFrame, batch: str | None = None) -> Version:
        """Appends rows (typed columns) as they are, as one segment; keys that are there already come to be there twice.

        A batch that is in already is not added again. No rows are no segment.
        """
        v = self.version()
        if v.has(batch):
            return v
        s = self._staged(rows, Mapping.from_json(v.mapping), v.next_id)
        changes = {} if s is None else {"segments": (*v.segments, s), "next_id": s.last + 1, "added": v.added + s.rows}
        return self._commit(v, **changes, batches=v.with_batch(batch))

    def upsert(self, rows: DataFrame, order_by: str | None = None, batch: str | None = None) -> Version:
        """Appends rows and buries what was there under their keys. Of rows of one key the last by order_by stays.

        Without order_by a key that is there twice in rows keeps any one of them.
        """
        v = self.version()
        if v.has(batch):
            return v
        mapping = Mapping.from_json(v.mapping)
        pk = mapping.primary_key
        if order_by:
            over = Window.partitionBy(pk).orderBy(F.desc(order_by))
            rows = rows.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__n")
        else:
            rows = rows.dropDuplicates([pk])
        s = self._staged(rows, mapping, v.next_id)
        if s is None:
            return self._commit(v, batches=v.with_batch(batch))
        new = self.spark.read.parquet(f"{self.path}/segments/{s.name}").select(pk)
        buried = self._bury(self._keyed(v, s.low, s.high).join(new, pk, "left_semi").select("_docid"))
        return self._commit(v, segments=(*v.segments, s), next_id=s.last + 1, added=v.added + s.rows, tombstones=(*v.tombstones, *buried), batches=v.with_batch(batch))

    def _bury(self, ids: DataFrame) -> list[str]:
        name = uuid.uuid4().hex
        ids.write.parquet(f"{self.path}/tombstones/{name}")
        return [name]

    def delete(self, keys: DataFrame) -> Version:
        """Buries the rows of keys (one column); unknown keys make no difference."""
        v = self.version()
        pk = Mapping.from_json(v.mapping).primary_key
        own = keys.select(F.col(keys.columns[0]).cast("string").alias(pk))
        low, high = own.agg(F.min(pk), F.max(pk)).first()
        if low is None:
            return v
        ids = self._keyed(v, low, high).join(own, pk, "left_semi").select("_docid")
        return self._commit(v, tombstones=(*v.tombstones, *self._bury(ids)))

    def delete_key(self, key: str) -> bool:
        """False if there is no such row."""
        pk = self.mapping().primary_key
        if self.rows().where(F.col(pk) == key).isEmpty():
            return False
        self.delete(self.spark.createDataFrame([(key,)], "k string"))
        return True

    # -- fields

    def add_field(self, name: str, kind: FieldType | str | int) -> Version:
        """No data is rewritten: older segments simply lack the field."""
        v = self.version()
        m = Mapping.from_json(v.mapping)
        m.add(name, kind)
        return self._commit(v, mapping=m.to_json())

    def drop_field(self, name: str) -> Version:
        """The field leaves the mapping; an unknown one is no error. Merging removes its data."""
        v = self.version()
        m = Mapping.from_json(v.mapping)
        m.drop(name)
        return self._commit(v, mapping=m.to_json())

    # -- maintenance

    def merge(self, start: int = -1, purge: bool = False, small: int = SMALL) -> Version:
        """Rewrites the segments from start on as one; by default from the first of fewer than small rows.

        Ids stay. Deleted rows stay too, unless purge says otherwise (their tombstones are kept: they do no harm).
        Fewer than two segments are left as they are.
        """
        v = self.version()
        if start < 0:
            start = next((i for i, s in enumerate(v.segments) if s.rows < small), len(v.segments))
        group = v.segments[start:]
        if len(group) < 2:
            return v
        df = self._segments(v, group)
        if purge and v.tombstones:
            df = df.join(self.at(v.number).tombstones(), "_docid", "left_anti")
        name = uuid.uuid4().hex
        df.repartitionByRange("_docid").sortWithinPartitions("_docid").write.option(f"parquet.bloom.filter.enabled#{Mapping.from_json(v.mapping).primary_key}", "true").parquet(f"{self.path}/segments/{name}")
        made = self._known(name, Mapping.from_json(v.mapping))
        made = (replace(made, first=group[0].first, last=group[-1].last),) if made else ()
        return self._commit(v, segments=(*v.segments[:start], *made))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes versions but the last keep, and the segments and tombstones that only they name."""
        numbers = self.versions()
        kept = [self.version(n) for n in numbers[-keep:]]
        used = {s.name for v in kept for s in v.segments} | {t for v in kept for t in v.tombstones}
        gone = []
        for folder in ("segments", "tombstones"):
            for n in self.files.names(folder):
                if n not in used:
                    self.files.remove(f"{folder}/{n}")
                    gone.append(n)
        for n in numbers[:-keep]:
            self.files.remove(f"versions/{n:08d}.json")
        return gone

    def destroy(self) -> None:
        self.files.remove("")

    # -- index

    def build_index(self, buckets: int = 64) -> DataFrame:
        """Writes the postings of this version's rows, deleted ones too, and reads them."""
        v = self.version()
        path = f"{self.path}/postings/{v.number:08d}"
        write_postings(postings(self.at(v.number).everything(), Mapping.from_json(v.mapping)), path, buckets)
        return read_postings(self.spark, path)

    def index(self) -> DataFrame:
        """The stored postings of this version."""
        return read_postings(self.spark, f"{self.path}/postings/{self.version().number:08d}")
