"""Several tables that change together: a manifest switches all of them at once; snapshots, scoped resets and restores.

A table is a list of Parquet folders that are never changed.  A manifest names the folders of every table with their
rows and a digest, and the highest manifest is the present state.  Writers put new folders first and the manifest last,
so one that dies in between leaves nothing but folders that no manifest names.  Two writers cannot both put the same
manifest: the later one fails and may try again.  ``place`` lies in storage that all executors share.

Scale: counts and digests are one aggregation a folder, taken when it is written; a snapshot and a restore copy
nothing, an append writes its own rows only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """What was asked would lose or mix data; nothing was changed."""


class TableSet:
    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place.rstrip("/")

    # --- manifests ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """Number of the present manifest; 0 before the first."""
        files, where = self._files(), self._path("manifests")
        if not files.exists(where):
            return 0
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.latest() if number is None else number
        if number == 0:
            return {"number": 0, "tables": {}, "note": ""}
        held = self._files().open(self._path(f"manifests/{number}.json"))
        try:
            return json.loads(bytes(held.readAllBytes()).decode())
        finally:
            held.close()

    def _put(self, tables: dict, note: str, after: int) -> dict:
        said = {"number": after + 1, "tables": tables, "note": note}
        files, draft, final = self._files(), self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{after + 1}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Refused(f"manifest {after + 1} is there already: another writer came first")
        return said

    # --- tables ---

    def _written(self, df: DataFrame) -> dict:
        path = f"{self.place}/tables/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return {"path": path, **self._facts(self.spark.read.schema(df.schema).parquet(path)), "schema": df.schema.json()}

    @staticmethod
    def _facts(df: DataFrame) -> dict:
        """Rows, and a digest that does not hang on their order."""
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0)
        r = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        return {"rows": r[0], "digest": str(r[1])}

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a manifest (default: the present one)."""
        from pyspark.sql.types import StructType

        entry = self.manifest(number)["tables"][name]
        schema = StructType.fromJson(json.loads(entry["schema"]))
        paths = [p["path"] for p in entry["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], note: str = "") -> int:
        """Put whole tables in place of those of the same names, all at once; the others stay.  Returns the manifest's number."""
        now = self.manifest()
        new = {}
        for name, df in tables.items():
            part = self._written(df)
            new[name] = {"schema": part.pop("schema"), "parts": [part]}
        return self._put(now["tables"] | new, note, now["number"])["number"]

    def append(self, rows: dict[str, DataFrame], note: str = "") -> int:
        """Add rows to tables (an audit log, observations), all at once; what is there is not written again."""
        now = self.manifest()
        tables = dict(now["tables"])
        for name, df in rows.items():
            part = self._written(df)
            schema = part.pop("schema")
            if name in tables and [f["name"] for f in json.loads(tables[name]["schema"])["fields"]] != df.columns:
                raise Refused(f"{name} has other columns")
            tables[name] = {"schema": tables.get(name, {}).get("schema", schema), "parts": [*tables.get(name, {}).get("parts", []), part]}
        return self._put(tables, note, now["number"])["number"]

    def counts(self, number: int | None = None) -> dict[str, int]:
        return {name: sum(p["rows"] for p in t["parts"]) for name, t in self.manifest(number)["tables"].items()}

    def verify(self, number: int | None = None) -> None:
        """Read every folder of a manifest again; refuse if one is not what was written."""
        from pyspark.sql.types import StructType

        for name, t in self.manifest(number)["tables"].items():
            schema = StructType.fromJson(json.loads(t["schema"]))
            for p in t["parts"]:
                if self._facts(self.spark.read.schema(schema).parquet(p["path"])) != {"rows": p["rows"], "digest": p["digest"]}:
                    raise Refused(f"{name}: {p['path']} is not what was written")

    # --- reset and restore ---

    def reset(self, targets: list[str], depends: dict[str, list[str]], active: DataFrame | None = None, confirm: bool = False) -> dict:
        """Empty the targets and keep all else; without ``confirm`` only say what would go and stay.

        ``depends``: which tables each table refers to; one outside the targets that refers to a target refuses the
        reset, as do missing targets and rows in ``active`` (runs that have not ended).  The present manifest is verified
        first: it is the snapshot to restore from.
        """
        now = self.manifest()
        before = self.counts(now["number"])
        if missing := sorted(set(targets) - set(before)):
            raise Refused(f"missing tables: {missing}")
        if other := sorted(n for n, refers in depends.items() if n not in targets and set(refers) & set(targets)):
            raise Refused(f"tables that depend on a target: {other}")
        report = {"snapshot": now["number"], "delete": {n: before[n] for n in targets}, "preserve": {n: c for n, c in before.items() if n not in targets}, "confirmed": confirm}
        if not confirm:
            return report
        if active is not None and not active.isEmpty():
            raise Refused("runs are active")
        self.verify(now["number"])
        tables = {n: ({**t, "parts": []} if n in targets else t) for n, t in now["tables"].items()}
        self._put(tables, f"reset of {', '.join(targets)}", now["number"])
        return report | {"after": self.counts()}

    def restore(self, number: int, targets: list[str]) -> dict:
        """The targets as of a manifest.  Refused where a target is not empty, has other columns, or anything else has changed since."""
        old, now = self.manifest(number), self.manifest()
        present = self.counts(now["number"])
        if full := sorted(n for n in targets if present.get(n, 0)):
            raise Refused(f"not empty: {full}")
        if set(old["tables"]) != set(now["tables"]) or any(old["tables"][n] != now["tables"][n] for n in now["tables"] if n not in targets):
            raise Refused("preserved tables differ")
        if any(old["tables"][n]["schema"] != now["tables"][n]["schema"] for n in targets):
            raise Refused("columns differ")
        self.verify(number)
        self._put(old["tables"], f"restore of {number}", now["number"])
        return {"restored": number, "counts": self.counts()}
