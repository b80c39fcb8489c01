"""Subtitles kept by id: runs replace the ids they bring all at once, and readers see whole runs only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..profile import DEFAULT, SiteProfile
from .io import dealt, good_subtitles

#: As ``write_subtitles`` takes them.
SUBTITLE = "id string, name string, encoding string, text string, n_bytes long, cached_at timestamp"


class StaleRun(RuntimeError):
    """Another run was committed meanwhile; nothing of this one can be seen."""


class SubtitleStore:
    """A folder of versions and manifests.

    A version holds whole prefixes (the first three characters of ids): those that a run touched, with the ids it
    brought and the others that the prefix had. A manifest, one small file a run, names the version of each prefix;
    there are about 1100 prefixes at most. It appears by a rename that fails if there is one of this number, so a run
    is committed as a whole or not at all; what a failed run leaves is in no manifest and goes with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, profile: SiteProfile = DEFAULT) -> None:
        self.spark, self.path, self.profile = spark, path.rstrip("/"), profile
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def runs(self) -> list[int]:
        """The numbers of committed runs, oldest first."""
        return [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, run: int | None = None) -> dict[str, str]:
        """The version of each prefix after a run, the last one if none is named."""
        known = self.runs()
        run = known[-1] if run is None and known else run
        if run is None:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{run:010d}.json", wholetext=True).first()[0])

    def _read(self, versions: dict[str, str]) -> DataFrame:
        out = self.spark.createDataFrame([], SUBTITLE)
        of: dict[str, list[str]] = {}
        for prefix, version in versions.items():
            of.setdefault(version, []).append(prefix)
        for version in sorted(of):
            rows = self.spark.read.schema(f"{SUBTITLE}, id_prefix string").parquet(f"{self.path}/data/{version}")
            out = out.unionByName(rows.where(F.col("id_prefix").isin(of[version])).drop("id_prefix"))
        return out

    def read(self, run: int | None = None) -> DataFrame:
        """The subtitles after a run, one row an id: nothing is merged or shuffled, of each version the live prefixes are taken.

        Files are sorted by prefix, so of one that has no live prefix no row group is read.
        """
        return self._read(self.manifest(run))

    def commit(self, subtitles: DataFrame) -> int:
        """Put good subtitles in place of those with the same ids, all at once; the run's number.

        ``subtitles`` as ``write_subtitles`` takes them; of rows that repeat an id the one cached last counts. Those with
        an error, without a text or too large change nothing. Touched prefixes are written anew, about as many bytes
        in each task. Without any good row there is a run that changes nothing.
        """
        before = self.runs()
        number, old = (before[-1] if before else 0) + 1, self.manifest(before[-1]) if before else {}
        columns = [c.split()[0] for c in SUBTITLE.split(", ")]
        good = good_subtitles(subtitles, self.profile).select(*columns)
        touched = {r[0] for r in good.select(prefix().alias("p")).distinct().collect()}
        if touched:
            version = uuid.uuid4().hex
            kept = self._read({p: old[p] for p in touched if p in old})
            both = kept.withColumn("__new", F.lit(0)).unionByName(good.withColumn("__new", F.lit(1))).withColumn("id_prefix", prefix())
            # Texts move once; in the order of ids, the first row of each is the one that counts.
            spread = dealt(both, "id_prefix", F.col("n_bytes"), F.col("id"))
            order = [F.col(c).desc_nulls_last() for c in ("__new", "cached_at", "n_bytes", "text")]
            only = _firsts(spread.sortWithinPartitions("id_prefix", "id", *order).select(*columns, "id_prefix"))
            only.write.option("compression", "zstd").parquet(f"{self.path}/data/{version}")
            written = self.spark.read.parquet(f"{self.path}/data/{version}").select("id_prefix").distinct()
            if {r[0] for r in written.collect()} != touched:
                raise StaleRun("the subtitles changed while they were written")
            old |= dict.fromkeys(touched, version)
        self._publish(number, old)
        return number

    def _publish(self, number: int, versions: dict[str, str]) -> None:
        folder = f"{self.path}/manifest"
        self._fs.mkdirs(self._at(folder))
        draft, final = self._at(f"{folder}/.{uuid.uuid4().hex}"), self._at(f"{folder}/{number:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise StaleRun(f"run {number} was committed meanwhile")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` runs and the versions that none of these names; no run may be under way."""
        runs = self.runs()
        live = {v for run in runs[-keep:] for v in self.manifest(run).values()}
        gone = [v for v in self._names("data") if v not in live]
        for run in runs[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifest/{run:010d}.json"), False)
        for version in gone:
            self._fs.delete(self._at(f"{self.path}/data/{version}"), True)
        return gone


def _firsts(ordered: DataFrame) -> DataFrame:
    """Of rows that lie in the order of ids the first of each id, partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids = batch.column("id").to_pylist()
            first = [x != y for x, y in zip(ids, [last, *ids], strict=False)]
            last = ids[-1] if ids else last
            yield batch.filter(pa.array(first, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def prefix() -> Column:
    return F.substring("id", 1, 3)
