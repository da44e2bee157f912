"""Versioned tables on plain Parquet: commits, upserts, replacement by key, history, time travel, changes.

A table is a folder with a log of versions, `_log/<n>.json`, and folders of Parquet files, the segments. A version names its
segments, at most MAX_SEGMENTS whatever the number of their files, so a log entry has the same size for any table. Two kinds:

- a base segment holds rows;
- a delta segment holds the changes of one commit, one row each: inserted rows, updated rows before and after, deleted rows. Those that
  are gone say where they were, as file and row number. So one folder is what a commit adds to the table, what it takes away
  and what the change feed shows of it, and an upsert writes in proportion to its rows, however scattered their keys are.

Reading a version is one scan of its segments without what deltas take away (an anti-join by file and row number, which is
broadcast if it is small; without deltas there is none). When segments become many, a commit merges those that are small beside
the rest; when much of the table is gone, all of it.

Which files an upsert reads: a segment's rows are dealt into files by ranges of a hash of the keys, and `stats/<segment>` holds, for every
file, the range and a Bloom filter of the hashes, made by the tasks that read the keys. An upsert joins its keys with
them by ranges and reads the files that may hold one, where that leaves files out.

A version exists once its log file does. That is written under another name and then moved into its place, which fails if the place is
taken: of two writers one fails, a writer that is lost leaves no version, and a reader never sees half a commit. On a local
disk that is a hard link, on HDFS a rename; an object store whose rename replaces files gives no such promise, so there a table
must have one writer. Nothing that was written is overwritten.

Rows that come in are cast to the table's schema; a value that does not fit, a column that the table hasn't, a constraint that
does not hold, are errors and leave no version. `add_columns` lets new columns in: rows of before have nulls there, and older versions
are read as they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StringType, StructField, StructType

#: Rows of a file, about, and segments of a version at most.
ROWS_PER_FILE, MAX_SEGMENTS = 1_000_000, 16
#: A segment is left alone by a merge of segments if it has so many times the rows of all smaller ones.
MUCH_LARGER = 4
#: Rows that are gone, in parts of those that are there, beyond which all segments are merged.
MOST_GONE = 0.3
#: Files are left out of an upsert if the table has more than FEW_FILES, and LEAST_SHARE times as many rows as the upsert.
FEW_FILES, LEAST_SHARE = 4, 8
#: Files that an upsert names one by one at most; it reads whole segments if they are more.
MOST_LISTED = 10_000
#: A file whose hashes spread over more cells of the hashes' range is a small delta, which is read in any case.
WIDE = 64
#: Bits of a Bloom filter for each key, and places that a key sets.
BLOOM_BITS, BLOOM_PLACES = 10, 5

_INSERT, _DELETE, _BEFORE, _AFTER = "insert", "delete", "update_preimage", "update_postimage"
_KIND, _VERSION, _TIME = "_change_type", "_commit_version", "_commit_timestamp"
_FILE, _ROW, _OLD_FILE, _OLD_ROW = "_file_name", "_row_index", "_origin_file", "_origin_row"
#: Columns that deltas have besides the table's.
_MARKS = [StructField(_KIND, StringType()), StructField(_OLD_FILE, StringType()), StructField(_OLD_ROW, LongType()), StructField(_VERSION, LongType()), StructField(_TIME, StringType())]
#: Names that a table's columns can't have.
RESERVED = {_KIND, _VERSION, _TIME, _FILE, _ROW, _OLD_FILE, _OLD_ROW, "_metadata"}


class ConcurrentCommit(Exception):
    """Another writer has committed this version."""


class RepeatedKeys(ValueError):
    """A merge's source has several rows of one key."""


class ConstraintViolation(ValueError):
    """Rows for which a constraint of the table is false, or which have a null where none may be."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    # The log

    def version(self) -> int | None:
        """The latest; None if there is no table."""
        log = self._at("_log")
        if not self._fs.exists(log):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def exists(self) -> bool:
        return self.version() is not None

    def entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no table at {self.path}")
        stream = self._fs.open(self._at("_log", _log_name(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _entries(self, first: int, last: int) -> list[dict]:
        """Entries of versions first..last; many are read by the executors."""
        if last - first < 8:
            return [self.entry(v) for v in range(first, last + 1)]
        paths = [f"{self.path}/_log/{_log_name(v)}" for v in range(first, last + 1)]
        found = [json.loads(r[0]) for r in self.spark.read.text(paths, wholetext=True).collect()]
        return sorted(found, key=lambda e: e["version"])

    def _commit(self, version: int, entry: dict) -> int:
        path = self._at("_log", _log_name(version))
        body = json.dumps({"timestamp": _now(), **entry, "version": version}).encode()
        written = self._at("_log", f".{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(written, False)
        stream.write(body)
        stream.close()
        try:
            self._move(written, path)
        except Exception as e:
            if self._fs.exists(path):
                raise ConcurrentCommit(f"version {version} of {self.path} is taken") from e
            raise
        finally:
            self._fs.delete(written, False)
        self._follow()
        return version

    def _move(self, written, path) -> None:
        """Move a file to a place where none may be. A local rename would replace one, a link fails."""
        fs = self._jvm.org.apache.hadoop.fs
        if self._fs.getUri().getScheme() == "file":
            at = [self._jvm.java.io.File(fs.Path.getPathWithoutSchemeAndAuthority(p).toString()).toPath() for p in (path, written)]
            self._jvm.java.nio.file.Files.createLink(*at)
            return
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(written, path, none)

    # Reading

    def _scan(self, names: Sequence[str], schema: StructType, files: Sequence[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{n}" for n in (names if files is None else files)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _gone(self, entry: dict) -> DataFrame | None:
        """Where the rows were that the version's deltas have taken away."""
        names = [s["name"] for s in entry["segments"] if s["delta"]] + entry["gone"]
        if not names or not entry["n_gone"]:
            return None
        return self._scan(names, StructType(_MARKS)).where(F.col(_KIND).isin(_BEFORE, _DELETE)).select(_OLD_FILE, _OLD_ROW)

    def _live(self, entry: dict, segments: Sequence[dict] | None = None, files: Sequence[str] | None = None, places: bool = False) -> DataFrame:
        """Rows of the version; only those of some segments or files; with `places` also their file and row number."""
        schema, segments = _schema(entry), entry["segments"] if segments is None else segments
        columns, delta, gone = [F.col(f"`{f.name}`") for f in schema.fields], any(s["delta"] for s in segments), self._gone(entry)
        rows = self._scan([s["name"] for s in segments], StructType([*schema.fields, *_MARKS]) if delta else schema, files)
        if delta:
            rows = rows.where(F.col(_KIND).isNull() | F.col(_KIND).isin(_INSERT, _AFTER))
        if not segments or files == []:
            return rows.select(*columns, *([F.lit("").alias(_FILE), F.lit(0).cast("long").alias(_ROW)] if places else []))
        if gone is None and not places:
            return rows.select(*columns)
        rows = rows.select(*columns, F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
        if gone is not None:
            rows = rows.join(gone, (F.col(_FILE) == F.col(_OLD_FILE)) & (F.col(_ROW) == F.col(_OLD_ROW)), "left_anti")
        return rows if places else rows.select(*columns)

    def read(self) -> DataFrame:
        return self._live(self.entry())

    def as_of(self, version: int) -> DataFrame:
        return self._live(self.entry(version))

    def history(self) -> DataFrame:
        """One row per version, latest first."""
        told = "version long, timestamp string, operation string, parameters string, metrics string, properties string"
        if not self.exists():
            return self.spark.createDataFrame([], told)
        return self.spark.read.schema(told).json(f"{self.path}/_log/*.json").orderBy(F.desc("version"))

    def changes(self, first: int = 0, last: int | None = None) -> DataFrame:
        """What versions first..last changed: the columns of the last, `_change_type` (insert, delete, update_preimage,
        update_postimage), `_commit_version` and `_commit_timestamp`. All deltas are one scan, without a join; the first version and
        an overwrite insert all of their rows, and an overwrite deletes all before it."""
        last = self.version() if last is None else last
        entries = self._entries(max(0, first - 1), last)
        before = {e["version"]: e for e in entries}
        entries = [e for e in entries if e["version"] >= first]
        if not entries:
            raise ValueError(f"no versions {first} to {last}")
        columns = [F.col(f"`{f.name}`") for f in _schema(entries[-1]).fields]
        marks = [F.col(c) for c in (_KIND, _VERSION, _TIME)]
        deltas = [e["delta"] for e in entries if e["delta"]]
        parts = [self._scan(deltas, StructType([*_schema(entries[-1]).fields, *_MARKS])).select(*columns, *marks)] if deltas else []
        for e in entries:
            for kind, rows in ((_DELETE, before.get(e["version"] - 1)), (_INSERT, e)) if e["whole"] else ():
                if rows is not None:
                    lits = [F.lit(kind).alias(_KIND), F.lit(e["version"]).cast("long").alias(_VERSION), F.lit(e["timestamp"]).alias(_TIME)]
                    parts.append(self._live({**rows, "schemas": entries[-1]["schemas"]}).select(*columns, *lits))
        if not parts:
            return self._scan([], StructType([*_schema(entries[-1]).fields, *_MARKS])).select(*columns, *marks)
        return reduce(DataFrame.unionByName, parts)

    # Writing

    @contextmanager
    def _writing(self) -> Iterator[_Folders]:
        """The folders of one commit: staged rows go in the end, segments if the commit fails."""
        folders = _Folders(self)
        try:
            yield folders
        except BaseException:
            for path in folders.written:
                self._fs.delete(path, True)
            raise
        finally:
            for path in folders.staged:
                self._fs.delete(path, True)

    def _evolved(self, entry: dict, df: DataFrame, add_columns: bool) -> dict:
        """The entry with the columns that df adds to the table; they are refused unless add_columns."""
        known = {f.name.lower() for f in _schema(entry).fields}
        new = [f for f in df.schema.fields if f.name.lower() not in known]
        if not new:
            return entry
        if not add_columns:
            raise ValueError(f"{self.path} has no columns {[f.name for f in new]}")
        _refuse_reserved(f.name for f in new)
        fields = [*_schema(entry).fields, *(StructField(f.name, f.dataType, True) for f in new)]
        return {**entry, "schemas": [*entry["schemas"], json.loads(StructType(fields).json())]}

    def _checked(self, rows: DataFrame, entry: dict) -> None:
        """Raise if any row breaks a constraint."""
        rules = {**{f"{c} is not null": F.col(f"`{c}`").isNotNull() for c in entry["not_null"]}, **{n: F.expr(e) for n, e in entry["checks"].items()}}
        if rules:
            broken = rows.agg(*[F.count_if(~c).alias(f"r{i}") for i, c in enumerate(rules.values())]).first()
            if wrong := {name: n for name, n in zip(rules, broken) if n}:
                raise ConstraintViolation(f"rows for {self.path} break {wrong}")

    def create(
        self, df: DataFrame, keys: Sequence[str], properties: dict | None = None, unique: bool = False, not_null: Sequence[str] = (), checks: dict[str, str] | None = None
    ) -> int:
        """Version 0. Properties are set here and then stay. `checks` names conditions that are false for no row, ever."""
        _refuse_reserved(df.columns)
        entry = {
            "keys": list(keys), "unique": unique, "properties": json.dumps(properties or {}), "schemas": [json.loads(df.schema.json())],
            "not_null": list(not_null), "checks": dict(checks or {}), "segments": [], "gone": [], "n_gone": 0,
        }
        with self._writing() as folders:
            name, rows = folders.segment(df, entry, 0)
            self._checked(self._scan([name], _schema(entry)), entry)
            if unique:
                self._no_repeats(self._scan([name], _schema(entry)), keys)
            if rows > ROWS_PER_FILE:
                name = folders.dealt(self._scan([name], _schema(entry)), entry, 0, rows, [name])
            made = {"operation": "CREATE", "parameters": "{}", "metrics": json.dumps({"rows": rows}), "segments": [_segment(name, rows, entry)]}
            return self._commit(0, {**entry, **made, "rows": rows, "delta": None, "whole": True})

    def _no_repeats(self, rows: DataFrame, keys: Sequence[str]) -> None:
        repeated = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if repeated:
            raise RepeatedKeys(f"several source rows have the key {repeated[0].asDict()}")

    def overwrite(self, df: DataFrame, add_columns: bool = False) -> int:
        old = self.entry()
        entry, version = self._evolved(old, df, add_columns), old["version"] + 1
        with self._writing() as folders:
            name, rows = folders.segment(df, entry, version)
            new = self._scan([name], _schema(entry))
            self._checked(new, entry)
            if entry["unique"]:
                self._no_repeats(new, entry["keys"])
            if rows > ROWS_PER_FILE:
                name = folders.dealt(new, entry, version, rows, [name])
            made = {"operation": "OVERWRITE", "parameters": "{}", "metrics": json.dumps({"rows": rows}), "segments": [_segment(name, rows, entry)], "gone": [], "n_gone": 0}
            return self._commit(version, {**entry, **made, "timestamp": _now(), "rows": rows, "delta": None, "whole": True})

    def replace_by_key(self, df: DataFrame, properties: dict | None = None, keys: Sequence[str] = ("source_file",), add_columns: bool = False) -> int:
        """All rows of the keys that df holds give way to df's rows; other keys stay, new ones come.
        One commit, however many keys."""
        if not self.exists():
            return self.create(df, keys, properties)
        entry = self._evolved(self.entry(), df, add_columns)
        keys = entry["keys"]
        with self._writing() as folders:
            source, n = folders.fit(df, entry)
            self._checked(source, entry)
            own = [f"_k{i}" for i in range(len(keys))]
            theirs = source.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)]).distinct()
            old, read = self._candidates(entry, source, n, places=True)
            same = reduce(Column.__and__, [old[f"`{k}`"].eqNullSafe(theirs[o]) for k, o in zip(keys, own)])
            old = old.join(theirs, same, "left_semi").withColumnsRenamed({_FILE: _OLD_FILE, _ROW: _OLD_ROW}).withColumn(_KIND, F.lit(_DELETE))
            none = {_OLD_FILE: F.lit(None).cast("string"), _OLD_ROW: F.lit(None).cast("long"), _KIND: F.lit(_INSERT)}
            changed = old.unionByName(source.withColumns(none))
            return self._apply(folders, entry, changed, 2 * n, "REPLACE", {"keys": keys}, read)

    def merge(
        self,
        df: DataFrame,
        keys: Sequence[str],
        properties: dict | None = None,
        delete_unmatched: bool = False,
        skip_unchanged: bool = False,
        add_columns: bool = False,
        incidental: Sequence[str] = (),
    ) -> int | None:
        """Upsert by keys, null-safe: rows of a known key take df's values, rows of new keys come, and with
        delete_unmatched rows of other keys go. Keys must be unique in df. With skip_unchanged no version is made
        (and None returned) if nothing changes. A row that differs in nothing but incidental columns, such as the time of the run
        that saw it, stays as it is, those columns included; one that differs in another takes all of df's values."""
        if not self.exists():
            return self.create(df, keys, properties, unique=True)
        entry = self.entry()
        if list(keys) != entry["keys"]:
            raise ValueError(f"{self.path} has the keys {entry['keys']}, not {list(keys)}")
        entry = self._evolved(entry, df, add_columns)
        if unknown := set(incidental) - {f.name for f in _schema(entry).fields} or set(incidental) & set(keys):
            raise ValueError(f"{sorted(unknown)} are keys or no columns of {self.path}")
        with self._writing() as folders:
            source, n = folders.fit(df, entry)
            self._checked(source, entry)
            self._no_repeats(source, keys)
            target, read = self._candidates(entry, source, None if delete_unmatched else n, places=True)
            changed = _differences(target, source, keys, _schema(entry), delete_unmatched, incidental)
            told = {"keys": list(keys), "delete_unmatched": delete_unmatched, "incidental": list(incidental)}
            return self._apply(folders, entry, changed, 2 * (entry["rows"] if delete_unmatched else 0) + 2 * n, "MERGE", told, read, skip_unchanged)

    def _apply(self, folders: _Folders, entry: dict, changed: DataFrame, most: int, operation: str, parameters: dict, read: dict, skip: bool = False) -> int | None:
        """Commit changed rows, of which there are `most` at most."""
        version, now = entry["version"] + 1, _now()
        name, n = folders.delta(changed, entry, version, now, most)
        inserted, updated, deleted = n[_INSERT], n[_AFTER], n[_DELETE]
        if not n["rows"]:
            folders.drop(name)
            if skip:
                return None
        rows = entry["rows"] + inserted - deleted
        segments = [*entry["segments"], *([_segment(name, inserted + updated, entry, True)] if n["rows"] else [])]
        metrics = {"inserted": inserted, "updated": updated, "deleted": deleted, **read}
        made = {"operation": operation, "parameters": json.dumps(parameters), "metrics": json.dumps(metrics), "timestamp": now, "rows": rows}
        made |= {"segments": segments, "n_gone": entry["n_gone"] + updated + deleted, "delta": name if n["rows"] else None, "whole": False}
        return self._commit(version, self._fewer(folders, {**entry, **made}, version))

    def _fewer(self, folders: _Folders, entry: dict, version: int, all_of_them: bool = False) -> dict:
        """The entry after segments are merged, if they are many or much of them is gone: those that are small beside the others, or all."""
        segments = sorted(entry["segments"], key=lambda s: s["rows"])
        if all_of_them or entry["n_gone"] > MOST_GONE * entry["rows"]:
            small = len(segments)
        elif len(segments) <= MAX_SEGMENTS:
            return entry
        else:
            small = len(segments) // 2
            while small < len(segments) and segments[small]["rows"] < MUCH_LARGER * sum(s["rows"] for s in segments[:small]):
                small += 1
        merged, kept = segments[:small], segments[small:]
        gone, n_gone = [], 0
        if kept and entry["n_gone"]:
            # Places of gone rows go with the files that they are in; those in kept files are told on, also where a delta tells them too.
            name, n_gone = folders.gone(self._gone(entry), self._scan([s["name"] for s in kept], StructType([])), version)
            gone = [name] if n_gone else []
        live = entry["rows"] - sum(s["rows"] for s in kept) + n_gone
        name = folders.dealt(self._live(entry, merged), entry, version, live, [])
        return {**entry, "segments": [*kept, _segment(name, live, entry)], "gone": gone, "n_gone": n_gone}

    def compact(self) -> int:
        """A version of one segment, with the same rows."""
        entry = self.entry()
        with self._writing() as folders:
            made = self._fewer(folders, entry, entry["version"] + 1, True)
            told = {"operation": "COMPACT", "parameters": "{}", "metrics": "{}", "timestamp": _now(), "delta": None, "whole": False}
            return self._commit(entry["version"] + 1, {**made, **told})

    def add_constraint(self, name: str, condition: str) -> int:
        """A condition that is false for no row from now on; an error if it is for one that is there."""
        entry = self.entry()
        self._checked(self.read(), {"not_null": [], "checks": {name: condition}})
        told = {"operation": "ADD CONSTRAINT", "parameters": json.dumps({name: condition}), "metrics": "{}", "timestamp": _now(), "delta": None, "whole": False}
        return self._commit(entry["version"] + 1, {**entry, **told, "checks": {**entry["checks"], name: condition}})

    def vacuum(self, keep: int = 10) -> int:
        """Delete the segments that none of the latest `keep` versions needs for its rows or changes; returns their number.
        Versions before can't be read any more, their log stays. No writer may be at work meanwhile."""
        latest = self.version()
        live: set[str] = set()
        for e in self._entries(max(0, latest - keep + 1), latest):
            live |= {s["name"] for s in e["segments"]} | set(e["gone"]) | {e["delta"]}
        found = [f.getPath() for f in self._fs.listStatus(self._at("data"))] if self._fs.exists(self._at("data")) else []
        gone = [p for p in found if p.getName() not in live]
        for path in gone:
            self._fs.delete(path, True)
            self._fs.delete(self._at("stats", path.getName()), True)
        return len(gone)

    # Which files may hold a key

    def _stats(self, segment: dict, keys: Sequence[str], schema: StructType) -> DataFrame:
        """One row per file of a segment: file, rows, low, high and bloom, of the hashes of its keys. Made when they are first asked for."""
        told, path = "file string, rows long, low long, high long, bloom binary", f"{self.path}/stats/{segment['name']}"
        if not self._fs.exists(self._at("stats", segment["name"], "_SUCCESS")):
            rows = self._scan([segment["name"]], StructType([*schema.fields, *_MARKS]))
            if segment["delta"]:
                rows = rows.where(F.col(_KIND).isin(_INSERT, _AFTER))
            hashes = rows.select(F.col("_metadata.file_name").alias("file"), _hash(keys).alias("h"))
            hashes.groupBy("file").applyInArrow(_file_stats, told).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(told).parquet(path)

    def _candidates(self, entry: dict, source: DataFrame, n: int | None, places: bool) -> tuple[DataFrame, dict]:
        """The rows of the files that may hold a key of source, which has n rows, and how many files that are of how many."""
        keys, total = entry["keys"], sum(s["files"] for s in entry["segments"])
        if n is None or not keys or total <= FEW_FILES or n * LEAST_SHARE > entry["rows"]:
            return self._live(entry, places=places), {"files_read": total, "files": total}
        of = [self._stats(s, keys, _schema(entry)).withColumn("file", F.concat(F.lit(f"{s['name']}/"), "file")) for s in entry["segments"]]
        bits = min(16, max(1, total.bit_length()))
        cell = lambda h: F.shiftrightunsigned(h, 64 - bits).cast("int").bitwiseXOR(F.lit(1 << (bits - 1)))
        files = reduce(DataFrame.unionByName, of).select("file", "bloom", cell(F.col("low")).alias("first"), cell(F.col("high")).alias("last"))
        narrow = files.where(F.col("last") - F.col("first") < WIDE).withColumn("cell", F.explode(F.sequence("first", "last"))).select("cell", "file", "bloom")
        hashes = source.select(_hash(keys).alias("h")).distinct().withColumn("cell", cell(F.col("h")))
        hit = hashes.groupBy("cell").cogroup(narrow.groupBy("cell")).applyInArrow(_may_hold, "file string")
        hit = hit.unionByName(files.where(F.col("last") - F.col("first") >= WIDE).select("file")).distinct()
        names = [r[0] for r in hit.limit(MOST_LISTED + 1).collect()]
        if len(names) > MOST_LISTED:
            return self._live(entry, places=places), {"files_read": total, "files": total}
        return self._live(entry, files=sorted(names), places=places), {"files_read": len(names), "files": total}

    # SQL

    def register(self, schema: str, name: str) -> None:
        """schema.name becomes a view of the latest version, also of those that are committed later."""
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
        self._show(schema, name)
        self._fs.create(self._at("_views", f"{schema}.{name}"), True).close()

    def _show(self, schema: str, name: str) -> None:
        """Properties tell SQL statements where the table's other versions are."""
        entry = self.entry()
        self.spark.sql(f"CREATE OR REPLACE VIEW {schema}.{name} TBLPROPERTIES ('{PATH_PROPERTY}' = '{self.path}') AS {self._as_sql(entry)}")

    def _as_sql(self, entry: dict) -> str:
        """A version's rows as a query of its files. Segments that were written with fewer columns have nulls in the others."""
        fields = _schema(entry).fields
        names = ", ".join(f"`{f.name}`" for f in fields)
        if not entry["segments"]:
            return f"SELECT {', '.join(f'CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`' for f in fields)} WHERE false"
        files = lambda of: f"parquet.`{self.path}/data/{{{','.join(of)}}}`"
        groups: dict[tuple, list[str]] = {}
        for s in entry["segments"]:
            groups.setdefault((s["schema"], s["delta"]), []).append(s["name"])
        parts, places = [], f", _metadata.file_name AS {_FILE}, _metadata.row_index AS {_ROW}" if entry["n_gone"] else ""
        for (number, delta), of in groups.items():
            known = {c["name"] for c in entry["schemas"][number]["fields"]}
            columns = ", ".join(f"`{f.name}`" if f.name in known else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
            parts.append(f"SELECT {columns}{places} FROM {files(of)}" + (f" WHERE {_KIND} IN ('{_INSERT}', '{_AFTER}')" if delta else ""))
        body = " UNION ALL ".join(parts)
        if not entry["n_gone"]:
            return body
        takers = [files(of) for of in ([s["name"] for s in entry["segments"] if s["delta"]], entry["gone"]) if of]
        gone = " UNION ALL ".join(f"SELECT {_OLD_FILE}, {_OLD_ROW} FROM {f} WHERE {_KIND} IN ('{_BEFORE}', '{_DELETE}')" for f in takers)
        return f"SELECT {names} FROM ({body}) LEFT ANTI JOIN ({gone}) ON {_FILE} = {_OLD_FILE} AND {_ROW} = {_OLD_ROW}"

    def _follow(self) -> None:
        """Bring the registered views to the latest version."""
        marks = self._at("_views")
        for f in self._fs.listStatus(marks) if self._fs.exists(marks) else []:
            schema, _, name = f.getPath().getName().partition(".")
            if name and not name.endswith(".crc") and self.spark.catalog.databaseExists(schema):
                self._show(schema, name)


class _Folders:
    """What one commit writes."""

    def __init__(self, table: VersionedTable) -> None:
        self.table, self.staged, self.written = table, [], []

    def _new(self, version: int) -> str:
        name = f"v{version}-{uuid.uuid4().hex}"
        self.written.append(self.table._at("data", name))
        return name

    def _fitted(self, df: DataFrame, entry: dict) -> DataFrame:
        """df in the table's schema."""
        fields, has = _schema(entry).fields, {c.lower() for c in df.columns}
        known = {f.name.lower() for f in fields}
        if missing := [f.name for f in fields if f.name.lower() not in has]:
            raise ValueError(f"rows for {self.table.path} lack {missing}")
        if more := [c for c in df.columns if c.lower() not in known]:
            raise ValueError(f"{self.table.path} has no columns {more}")
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])

    def _write(self, df: DataFrame, path: str, **counts: Column) -> dict[str, int]:
        seen = Observation()
        df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in counts.items()]).write.option("maxRecordsPerFile", 2 * ROWS_PER_FILE).parquet(path)
        return seen.get

    def fit(self, df: DataFrame, entry: dict) -> tuple[DataFrame, int]:
        """df in the table's schema, written aside: it is computed once, however often a commit reads it."""
        folder = f"_staged/{uuid.uuid4().hex}"
        self.staged.append(self.table._at(folder))
        path = f"{self.table.path}/{folder}"
        n = self._write(self._fitted(df, entry), path)["rows"]
        return self.table.spark.read.schema(_schema(entry)).parquet(path), n

    def segment(self, df: DataFrame, entry: dict, version: int) -> tuple[str, int]:
        """df as a base segment in files as they come."""
        name = self._new(version)
        return name, self._write(self._fitted(df, entry), f"{self.table.path}/data/{name}")["rows"]

    def dealt(self, rows: DataFrame, entry: dict, version: int, n: int, instead: Sequence[str]) -> str:
        """n rows as a base segment, dealt into files by the keys' hashes; segments that it stands for go."""
        name = self._new(version)
        self._write(_dealt(rows, entry, n), f"{self.table.path}/data/{name}")
        for other in instead:
            self.drop(other)
        return name

    def delta(self, changed: DataFrame, entry: dict, version: int, now: str, most: int) -> tuple[str, dict[str, int]]:
        name = self._new(version)
        columns = [f"`{f.name}`" for f in _schema(entry).fields]
        rows = changed.select(*columns, _KIND, _OLD_FILE, _OLD_ROW, F.lit(version).cast("long").alias(_VERSION), F.lit(now).alias(_TIME))
        counts = {k: F.count_if(F.col(_KIND) == k) for k in (_INSERT, _AFTER, _DELETE)}
        return name, self._write(_dealt(rows, entry, most), f"{self.table.path}/data/{name}", **counts)

    def gone(self, gone: DataFrame, kept: DataFrame, version: int) -> tuple[str, int]:
        """Those places of gone rows that lie in files of the kept segments."""
        name = self._new(version)
        files = kept.select(F.col("_metadata.file_name").alias(_FILE)).distinct()
        rows = gone.join(files, F.col(_OLD_FILE) == F.col(_FILE), "left_semi").distinct().withColumn(_KIND, F.lit(_DELETE))
        return name, self._write(rows, f"{self.table.path}/data/{name}")["rows"]

    def drop(self, name: str) -> None:
        self.table._fs.delete(self.table._at("data", name), True)


#: The view property that holds the table's folder.
PATH_PROPERTY = "verdigris.path"


def registered(spark: SparkSession, name: str) -> VersionedTable:
    """The table behind a registered view."""
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if PATH_PROPERTY not in found:
        raise ValueError(f"{name} is no view of a versioned table")
    return VersionedTable(spark, found[PATH_PROPERTY])


def _log_name(version: int) -> str:
    return f"{version:020d}.json"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _schema(entry: dict) -> StructType:
    return StructType.fromJson(entry["schemas"][-1])


def _segment(name: str, rows: int, entry: dict, delta: bool = False) -> dict:
    return {"name": name, "rows": rows, "files": max(1, -(-rows // ROWS_PER_FILE)), "delta": delta, "schema": len(entry["schemas"]) - 1}


def _refuse_reserved(names: Sequence[str]) -> None:
    if taken := sorted({n.lower() for n in names} & RESERVED):
        raise ValueError(f"a versioned table can't have columns named {taken}")


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0).cast("long")


def _dealt(rows: DataFrame, entry: dict, n: int) -> DataFrame:
    """rows in about n / ROWS_PER_FILE partitions, each a range of the keys' hashes. Where keys repeat, a common one takes several."""
    parts = max(1, -(-n // ROWS_PER_FILE))
    if parts == 1:
        return rows.repartition(1)
    if not entry["unique"]:
        return rows.repartitionByRange(parts, _hash(entry["keys"]), F.xxhash64(*[F.col(f"`{f.name}`") for f in _schema(entry).fields if _plain(f.dataType)]))
    share = (_hash(entry["keys"]).cast("double") / 2.0**64 + 0.5) * parts
    return rows.repartitionById(parts, F.least(F.floor(share), F.lit(parts - 1)).cast("int"))


def _differences(target: DataFrame, source: DataFrame, keys: Sequence[str], schema: StructType, delete_unmatched: bool, incidental: Sequence[str]) -> DataFrame:
    """What makes target, with places of its rows, into source by keys: changed rows with their kind and where they were. Rows
    are compared without the incidental columns."""
    columns = [f"`{f.name}`" for f in schema.fields]
    t = target.select(F.struct(*columns).alias("t"), F.col(_FILE), F.col(_ROW), *[F.col(f"`{k}`").alias(f"_t{i}") for i, k in enumerate(keys)])
    s = source.select(F.struct(*columns).alias("s"), *[F.col(f"`{k}`").alias(f"_s{i}") for i, k in enumerate(keys)])
    on = reduce(Column.__and__, [F.col(f"_t{i}").eqNullSafe(F.col(f"_s{i}")) for i in range(len(keys))])
    pair = t.join(s, on, "full_outer" if delete_unmatched else "right_outer")
    none = (F.lit(None).cast("string"), F.lit(None).cast("long"))
    change = lambda kind, row, file, at: F.struct(F.lit(kind).alias("kind"), F.col(row).alias("row"), file.alias("file"), at.alias("at"))
    was = (F.col(_FILE), F.col(_ROW))
    kinds = F.when(F.col(_FILE).isNull(), F.array(change(_INSERT, "s", *none)))
    kinds = kinds.when(F.col("s").isNull(), F.array(change(_DELETE, "t", *was)))
    compared = StructType([f for f in schema.fields if f.name not in incidental])
    told = lambda side: F.struct(*[comparable(F.col(side)[f.name], f.dataType).alias(f.name) for f in compared.fields])
    differ = ~told("t").eqNullSafe(told("s"))
    kinds = kinds.when(differ, F.array(change(_BEFORE, "t", *was), change(_AFTER, "s", *none)))
    found = pair.select(F.explode(kinds).alias("c"))
    return found.select("c.row.*", F.col("c.kind").alias(_KIND), F.col("c.file").alias(_OLD_FILE), F.col("c.at").alias(_OLD_ROW))


def _plain(kind: DataType) -> bool:
    """Whether values of the type hold no map."""
    if isinstance(kind, StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return _plain(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType)


def comparable(c: Column, kind: DataType) -> Column:
    """A value that is equal where c is: maps as their entries in order."""
    if _plain(kind):
        return c
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: comparable(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[comparable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each hash sets in a Bloom filter."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + np.arange(BLOOM_PLACES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _file_stats(rows: pa.Table) -> pa.Table:
    hashes = np.unique(rows.column("h").to_numpy())
    bits = -(-max(64, BLOOM_BITS * len(hashes)) // 8) * 8
    filled = np.zeros(bits, bool)
    filled[_places(hashes, bits).astype(np.int64)] = True
    one = {"file": rows.column("file")[0].as_py(), "rows": rows.num_rows, "low": int(hashes[0]), "high": int(hashes[-1]), "bloom": np.packbits(filled).tobytes()}
    return pa.Table.from_pylist([one], pa.schema([("file", pa.string()), ("rows", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("bloom", pa.binary())]))


def _may_hold(keys: pa.Table, files: pa.Table) -> pa.Table:
    found, hashes = [], keys.column("h").to_numpy() if keys.num_rows else np.zeros(0, np.int64)
    for file, bloom in zip(files.column("file").to_pylist() if files.num_rows else [], files.column("bloom") if files.num_rows else []):
        filled = np.unpackbits(np.frombuffer(bloom.as_py(), np.uint8))
        if len(hashes) and filled[_places(hashes, len(filled)).astype(np.int64)].all(axis=1).any():
            found.append(file)
    return pa.table({"file": pa.array(found, pa.string())})
