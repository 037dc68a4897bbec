"""Loading of registered tables: create, replace, append and upsert.

A table is a folder of immutable parts, and of versions that name the parts they have. A version
is there once its manifest is, which is renamed into place whole and never replaces another. A
reader never meets a half-written state, a job never overwrites what it reads, an append writes
its own rows only, and an upsert the partitions of keys that it touches.
"""

from __future__ import annotations

import datetime
import os
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import DataQualityError, identifier
from ..functions.text import populated
from ..operators.rules import col
from .awaited import Awaited
from .files import FixedColumn, read_source

MODES = ("append", "replace", "upsert")
LINEAGE = ("_source_file", "_ingested_at", "_load_run_id")
ROW_IDENTIFIER = "_dq_row_identifier"


@dataclass(frozen=True)
class Dataset:
    """A registered table."""

    name: str
    source_type: str = "csv"
    source_file: str | None = None
    table: str | None = None
    primary_key: str | None = None
    load_mode: str | None = None
    parser: tuple[FixedColumn, ...] = ()
    active: bool = True


@dataclass
class LoadSummary:
    dataset_name: str
    load_run_id: int
    mode: str
    rows_read: int
    rows_inserted: int
    rows_updated: int
    duration_seconds: float
    path: str
    details: dict = field(default_factory=dict)


@dataclass
class Manifest:
    """What a version has: its parts, and where its rows are dealt by key, the key and the
    number of partitions."""

    parts: list[str]
    token: str = ""
    after: Awaited | None = None
    key: str | None = None
    buckets: int = 0

    def text(self) -> str:
        heads = [("token", self.token)] if self.token else []
        heads += [("after", f"{self.after.table} {self.after.number} {self.after.token}")] if self.after else []
        heads += [("keyed", f"{self.buckets} {self.key}")] if self.key else []
        return "\n".join([f"#{name} {value}" for name, value in heads] + self.parts)

    @staticmethod
    def of(text: str) -> Manifest:
        out = Manifest([])
        for line in text.splitlines():
            head, _, value = line.partition(" ")
            if head == "#token":
                out.token = value
            elif head == "#after":
                name, number, token = value.split()
                out.after = Awaited(name, int(number), token)
            elif head == "#keyed":
                number, _, out.key = value.partition(" ")
                out.buckets = int(number)
            elif line:
                out.parts.append(line)
        return out


@dataclass(frozen=True)
class Upserted:
    read: int
    inserted: int
    updated: int
    path: str


class Taken(DataQualityError):
    """Another writer has published the version."""


BUCKET, _PIECE, _INCOMING = "veridat_bucket", "veridat_piece", "veridat_incoming"
_PIECES = 64  # of a partition of keys: tasks that can share it


class Store:
    """Versioned tables below one folder of any store that Spark reaches.

    ``buckets`` is the number of partitions of keys that a new keyed table gets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def folder(self, table: str) -> str:
        return os.path.join(self.root, identifier(table, "table name"))

    def _published(self, table: str, name: str | int | None = None) -> str:
        return os.path.join(self.folder(table), "published", *([] if name is None else [str(name)]))

    def _numbers(self, table: str) -> list[int]:
        """Numbers of all manifests, also of those that wait."""
        fs, p = self._fs(self._published(table))
        return sorted(int(n) for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit()) if fs.exists(p) else []

    def manifest(self, table: str, number: int) -> Manifest:
        fs, p = self._fs(self._published(table, number))
        stream = fs.open(p)
        try:
            return Manifest.of(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _holds(self, awaited: Awaited | None) -> bool:
        if awaited is None:
            return True
        fs, p = self._fs(self._published(awaited.table, awaited.number))
        return fs.exists(p) and self.manifest(awaited.table, awaited.number).token == awaited.token

    def version(self, table: str) -> int:
        """The last version that is there; 0 without any. Versions that wait for one of another
        table, as a broken run leaves them, aren't, and neither are empty manifests."""
        for number in reversed(self._numbers(table)):
            found = self.manifest(table, number)
            if found.parts and self._holds(found.after):
                return number
        return 0

    def exists(self, table: str) -> bool:
        return self.version(table) > 0

    def parts(self, table: str, version: int | None = None) -> list[str]:
        """The folders of a version, as its manifest names them."""
        return [os.path.join(self.folder(table), x) for x in self.manifest(table, version or self.version(table)).parts]

    def path(self, table: str, version: int | None = None) -> str:
        """The folder that a version added."""
        return self.parts(table, version)[-1].split(f"/{BUCKET}=")[0]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        number = version or self.version(table)
        if not number:
            raise DataQualityError(f"Table '{table}' does not exist.")
        return self.spark.read.parquet(*self.parts(table, number))

    def read_part(self, path: str) -> DataFrame:
        """The rows that one write has made, whether they are published or not."""
        return self.spark.read.parquet(path).drop(BUCKET)

    def next_version(self, table: str) -> int:
        return max(self._numbers(table), default=0) + 1

    def _new_part(self, table: str) -> str:
        return f"{uuid.uuid4().hex[:12]}/v={self.next_version(table)}"

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _publish(self, table: str, number: int, manifest: Manifest) -> None:
        """Writes the manifest beside its place and renames it there, unless that is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, beside = self._fs(self._published(table, f"_{uuid.uuid4().hex}"))
        stream = fs.create(beside, False)
        stream.write(manifest.text().encode())
        stream.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self._published(table, number))
        no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(beside).toUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(place), no_options)
        except Py4JJavaError as problem:
            fs.delete(beside, False)
            if fs.exists(place):
                raise Taken(f"Version {number} of table '{table}' was published by another writer.") from problem
            raise

    def _dealt(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Rows by partition of their key; the pieces of a partition are spread over tasks."""
        piece = F.pmod(F.xxhash64(col(key)), F.lit(buckets * _PIECES))
        return df.withColumn(_PIECE, piece.cast("int")).repartition(_PIECE).withColumn(BUCKET, F.pmod(F.col(_PIECE), F.lit(buckets)))

    def _write_dealt(self, table: str, part: str, df: DataFrame) -> list[str]:
        """Writes rows that were dealt; gives a part for each partition that has any."""
        path = os.path.join(self.folder(table), part)
        df.drop(_PIECE, _INCOMING).write.partitionBy(BUCKET).parquet(path)
        fs, p = self._fs(path)
        return sorted(f"{part}/{n}" for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(f"{BUCKET}=")) or [self._write_empty(table, df)]

    def _write_empty(self, table: str, df: DataFrame) -> str:
        """A part without rows that has the columns."""
        part = self._new_part(table)
        df.drop(_PIECE, _INCOMING, BUCKET).limit(0).write.parquet(os.path.join(self.folder(table), part))
        return part

    def _write_part(self, table: str, df: DataFrame, key: str | None, buckets: int) -> list[str]:
        part = self._new_part(table)
        if key:
            return self._write_dealt(table, part, self._dealt(df, key, buckets))
        df.write.parquet(os.path.join(self.folder(table), part))
        return [part]

    def write(self, table: str, df: DataFrame, token: str = "", after: Awaited | None = None, key: str | None = None) -> str:
        """``df`` as the next version; with ``key``, dealt by it, so that an upsert finds the
        partitions it touches. With ``after``, the version is seen once that one is there."""
        number, buckets = self.next_version(table), self.buckets if key else 0
        parts = self._write_part(table, df, key, buckets)
        self._publish(table, number, Manifest(parts, token, after, key, buckets))
        return os.path.join(self.folder(table), parts[-1].split(f"/{BUCKET}=")[0])

    def append(self, table: str, df: DataFrame, token: str = "", after: Awaited | None = None) -> str:
        """``df`` behind the rows there are, as a new version that shares their files. If another
        writer is first, the rows go behind theirs; a version with a token is then refused."""
        number = self.version(table)
        if not number:
            return self.write(table, df, token, after)
        known, own = self.read(table, number).schema, self.manifest(table, number)
        if set(known.names) != set(df.columns):
            raise DataQualityError(f"Columns differ from those of table '{table}': {sorted(set(known.names) ^ set(df.columns))}.")
        parts = self._write_part(table, df.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in known]), own.key, own.buckets)
        while True:
            own = self.manifest(table, self.version(table))
            try:
                self._publish(table, self.next_version(table), Manifest(own.parts + parts, token, after, own.key, own.buckets))
                return os.path.join(self.folder(table), parts[-1].split(f"/{BUCKET}=")[0])
            except Taken:
                if token:
                    raise

    def upsert(self, table: str, rows: DataFrame, key: str) -> Upserted:
        """Rows by key in place of those there are, others added. ``rows`` are computed once,
        into a staged part dealt by key; then only partitions that they touch are written
        anew. A key that is blank or repeated among ``rows`` is refused, and nothing changes."""
        number, target = self.version(table), self.next_version(table)
        known = self.manifest(table, number) if number else Manifest([])
        keyed = known.key == key
        buckets = known.buckets if keyed else self.buckets
        if number:
            check_schema(self.read(table, number), rows)
        staged, counted = self._new_part(table), Observation()
        place = os.path.join(self.folder(table), staged)
        parts = self._write_dealt(table, staged, self._dealt(rows, key, buckets).observe(counted, F.count("*").alias("n")))
        try:
            incoming = self.spark.read.parquet(*[os.path.join(self.folder(table), x) for x in parts])
            check_primary_key(incoming, key)
        except DataQualityError:
            self._remove(os.path.dirname(place))
            raise
        read = counted.get["n"]
        if not number:
            self._publish(table, target, Manifest(parts, key=key, buckets=buckets))
            return Upserted(read, read, 0, place)
        touched = {x.rsplit("/", 1)[1] for x in parts}
        stale = [x for x in known.parts if not keyed or x.rsplit("/", 1)[1] in touched]
        inserted, updated, new = read, 0, parts
        if stale:
            before = self.spark.read.parquet(*[os.path.join(self.folder(table), x) for x in stale])
            both = before.withColumn(_INCOMING, F.lit(False)).unionByName(incoming.withColumn(_INCOMING, F.lit(True)), allowMissingColumns=True)
            same = Window.partitionBy(_PIECE, key)
            kept = self._dealt(both, key, buckets).withColumns({"veridat_asked": F.max(_INCOMING).over(same), "veridat_known": ~F.min(_INCOMING).over(same)}).where(F.col(_INCOMING) | ~F.col("veridat_asked"))
            merged = Observation()
            watched = kept.observe(merged, F.count_if(F.col(_INCOMING) & ~F.col("veridat_known")).alias("inserted"), F.count_if(F.col(_INCOMING) & F.col("veridat_known")).alias("updated"))
            part = self._new_part(table)
            new = self._write_dealt(table, part, watched.drop("veridat_asked", "veridat_known"))
            inserted, updated = merged.get["inserted"], merged.get["updated"]
            place = os.path.join(self.folder(table), part)
            self._remove(os.path.join(self.folder(table), os.path.dirname(staged)))
        self._publish(table, target, Manifest([x for x in known.parts if x not in stale] + new, key=key, buckets=buckets))
        return Upserted(read, inserted, updated, place)

    def compact(self, table: str) -> str:
        """The rows of a table of many appends as one part, in a new version."""
        return self.write(table, self.read(table), key=self.manifest(table, self.version(table)).key)


def with_lineage(df: DataFrame, source_file: str, load_run_id: int, at: datetime.datetime | None = None) -> DataFrame:
    """The three lineage columns, one time for the whole load."""
    at = at or datetime.datetime.now(datetime.UTC)
    return df.withColumns({"_source_file": F.lit(source_file), "_ingested_at": F.lit(at), "_load_run_id": F.lit(load_run_id).cast("long")})


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*LINEAGE, ROW_IDENTIFIER)]


def check_schema(existing: DataFrame, incoming: DataFrame) -> None:
    have, get = set(business_columns(existing)), set(business_columns(incoming))
    if have != get:
        raise DataQualityError(f"Columns differ from the table's. Missing: {sorted(have - get)}. Unexpected: {sorted(get - have)}.")


def check_primary_key(df: DataFrame, key: str | None) -> None:
    """Raises if the key is absent, blank or not unique; it names up to ten values."""
    if not key:
        raise DataQualityError("Upsert needs a registered primary key.")
    if key not in df.columns:
        raise DataQualityError(f"Primary key '{key}' is not a column of the file.")
    blank = df.where(~populated(col(key))).count()
    if blank:
        raise DataQualityError(f"Primary key '{key}' is null or blank in {blank} rows.")
    repeated = df.groupBy(col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    if shown := [r.k for r in repeated.orderBy("k").limit(10).collect()]:
        raise DataQualityError(f"Primary key '{key}' has duplicate values, such as {shown}.")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` whose key ``incoming`` lacks, and all of ``incoming``."""
    return existing.join(incoming.select(col(key)), key, "left_anti").select(*existing.columns).unionByName(incoming, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(rows_inserted, rows_updated): incoming keys that are new, and those that are known."""
    known = existing.select(col(key).alias("key")).withColumn("known", F.lit(True))
    marked = incoming.select(col(key).alias("key")).join(known, "key", "left")
    return marked.agg(F.count_if(F.col("known").isNull()).alias("rows_inserted"), F.count_if(F.col("known")).alias("rows_updated"))


def load_mode(dataset: Dataset, requested: str | None = None) -> str:
    mode = (requested or dataset.load_mode or "upsert").lower()
    if mode not in MODES:
        raise DataQualityError(f"Unsupported load mode: {mode}")
    return mode


def load(store: Store, dataset: Dataset, load_run_id: int, file: str | None = None, mode: str | None = None) -> LoadSummary:
    """One file into the table of ``dataset``. The first load creates it, whatever the mode."""
    began = datetime.datetime.now(datetime.UTC)
    mode = load_mode(dataset, mode)
    if not dataset.active:
        raise DataQualityError(f"Dataset '{dataset.name}' is not active.")
    path = file or dataset.source_file
    if not path:
        raise DataQualityError(f"No file for dataset '{dataset.name}'.")
    table = dataset.table or dataset.name
    parsed = read_source(store.spark, dataset.source_type, path, list(dataset.parser))
    key = dataset.primary_key if dataset.primary_key in parsed.columns else None
    if mode == "upsert" and not key:
        check_primary_key(parsed, dataset.primary_key)
    rows = with_lineage(parsed, path, load_run_id, began)
    # set once at load, so failures name the same row in every later job
    fallback = F.concat(F.lit(f"load:{load_run_id}:"), F.sha2(F.concat_ws("\x1f", *[col(c) for c in parsed.columns]), 256))
    rows = rows.withColumn(ROW_IDENTIFIER, col(key).cast("string") if key else fallback)
    if mode == "upsert":
        done = store.upsert(table, rows, key)
    else:
        counted = Observation()
        watched = rows.observe(counted, F.count("*").alias("n"))
        if mode == "append" and store.exists(table):
            check_schema(store.read(table), rows)
            written = store.append(table, watched)
        else:
            written = store.write(table, watched, key=key)
        done = Upserted(counted.get["n"], counted.get["n"], 0, written)
    seconds = (datetime.datetime.now(datetime.UTC) - began).total_seconds()
    return LoadSummary(dataset.name, load_run_id, mode, done.read, done.inserted, done.updated, seconds, done.path)


@dataclass(frozen=True)
class ReferenceDataset:
    name: str
    table: str
    key_columns: tuple[str, ...]
    columns: tuple[str, ...]
    version: str | None = None


# The registered reference tables.
REFERENCES = (
    ReferenceDataset("us_states", "us_state", ("state_code",), ("state_code", "state_name", "state_fips")),
    ReferenceDataset("us_counties", "us_county", ("state_code", "county_fips"), ("state_code", "county_fips", "county_name", "full_fips")),
    ReferenceDataset("us_places", "us_place", ("state_code", "place_fips"), ("state_code", "place_fips", "place_name")),
    ReferenceDataset("us_zip_codes", "us_zip_code", ("zip_code", "place_name", "state_code"), ("zip_code", "place_name", "state_code", "county_fips", "latitude", "longitude")),
    ReferenceDataset("us_fips", "us_fips", ("fips_code",), ("fips_code", "fips_type", "name", "state_code")),
    ReferenceDataset("naics", "naics", ("naics_code",), ("naics_code", "title", "hierarchy_level", "publication_year")),
)


def load_reference(store: Store, reference: ReferenceDataset, file: str, replace: bool = False, source_version: str | None = None) -> int:
    """Rows of a CSV file into a reference table; here an empty field is null."""
    df = store.spark.read.csv(file, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    if extra := [c for c in df.columns if c not in reference.columns]:
        raise DataQualityError(f"Columns {extra} are not registered for reference dataset '{reference.name}'.")
    missing = [c for c in reference.columns if c not in df.columns]
    rows = df.select(*[(F.lit(None).cast("string") if c in missing else col(c)).alias(c) for c in reference.columns]).withColumns({"refreshed_at": F.current_timestamp(), "source_version": F.lit(source_version or reference.version).cast("string")})
    counted = Observation()
    watched = rows.observe(counted, F.count("*").alias("n"))
    store.write(reference.table, watched) if replace else store.append(reference.table, watched)
    return counted.get["n"]


def reference_tables(store: Store, references=REFERENCES) -> dict:
    """Loaded reference tables as rules take them: name to (frame, key columns)."""
    return {r.name: (store.read(r.table), r.key_columns) for r in references if store.exists(r.table)}
