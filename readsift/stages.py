"""Stages of a study with a resume guard: each writes its tables aside, publishes them by rename, and leaves a record.

A run lives in one folder, named by ``run_folder`` after its label cut-offs, with the settings beside the outputs.
A stage counts as done while its record names the run of every stage it reads from and its tables exist. A stage
that dies leaves no record, and what it had written aside is never read. Tables stay on the file system that the
folder is on; nothing passes through the driver but the records, one line a stage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.profiles import Profile, provenance
from .sources.text import done, run_tag, write_table

#: Reads a published table by name.
Read = Callable[[str], DataFrame]
RECORDS, ASIDE, SETTINGS = "_stages", "_aside", "settings"


@dataclass(frozen=True)
class Stage:
    """``work`` maps a reader of published tables to the stage's own tables by name; ``reads`` are names of earlier stages."""

    name: str
    outputs: tuple[str, ...]
    work: Callable[[Read], Mapping[str, DataFrame]]
    reads: tuple[str, ...] = ()


def run_folder(root: str, profile: Profile) -> str:
    """The folder of the runs with these cut-offs."""
    return f"{root.rstrip('/')}/{run_tag(profile.name, profile.min_identity, profile.min_coverage)}"


class Run:
    """The stages of one folder, in order. Names of stages and of tables must be unique, and a stage reads only earlier ones."""

    def __init__(self, spark: SparkSession, folder: str, stages: Sequence[Stage]):
        names, tables = [s.name for s in stages], [t for s in stages for t in s.outputs]
        for kind, xs in (("stage", names), ("table", tables)):
            if len(set(xs)) < len(xs):
                raise ValueError(f"a {kind} is named twice")
        for i, s in enumerate(stages):
            if late := set(s.reads) - set(names[:i]):
                raise ValueError(f"stage {s.name} reads {sorted(late)}, which no earlier stage is")
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), list(stages)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def _move(self, source, target) -> None:
        self._fs.delete(target, True)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")

    def record(self, name: str) -> dict | None:
        """What the last complete run of a stage left: its id, and the ids of the runs it read. Half a record is none."""
        path = self._path(RECORDS, f"{name}.json")
        if not self._fs.exists(path):
            return None
        lines = self.spark.read.text(path.toString(), wholetext=True).collect()  # one short file
        try:
            return json.loads(lines[0][0]) if lines else None
        except ValueError:
            return None

    def _keep_record(self, name: str, record: dict) -> None:
        aside = self._path(ASIDE, f"{uuid.uuid4().hex}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(record, sort_keys=True), "utf-8"))
        out.close()
        self._move(aside, self._path(RECORDS, f"{name}.json"))

    def states(self) -> dict[str, str]:
        """``done``, ``stale`` (a stage it reads ran since, or is not done), ``missing`` or ``lost`` (a record without its tables)."""
        records, out = {s.name: self.record(s.name) for s in self.stages}, {}
        for s in self.stages:
            r = records[s.name]
            if r is None or r.get("tables") != list(s.outputs):
                out[s.name] = "missing"
            elif not done(self.spark, [f"{self.folder}/{t}" for t in s.outputs]):
                out[s.name] = "lost"
            else:
                fresh = all(out[u] == "done" and r["reads"].get(u) == records[u]["id"] for u in s.reads)
                out[s.name] = "done" if fresh else "stale"
        return out

    def status(self) -> DataFrame:
        """(place, stage, state, tables), a row a stage."""
        state = self.states()
        rows = [(i, s.name, state[s.name], list(s.outputs)) for i, s in enumerate(self.stages, 1)]
        return self.spark.createDataFrame(rows, "place int, stage string, state string, tables array<string>")

    def run(self, start: str | None = None, only: Iterable[str] | None = None) -> list[str]:
        """Run what is not done; returns the names of the stages that ran.

        ``start`` runs that stage and all later ones whatever their state, and none before. ``only`` runs just these. A stage
        that reads one which is not done then is refused.
        """
        names = [s.name for s in self.stages]
        only = None if only is None else set(only)
        if odd := sorted(({start} if start else set()) - set(names)) + sorted((only or set()) - set(names)):
            raise ValueError(f"no stage is named {odd}")
        first = names.index(start) if start else 0
        forced = {n for i, n in enumerate(names) if (i >= first if start else only is not None) and (only is None or n in only)}
        ran = []
        for i, s in enumerate(self.stages):
            if i < first or (only is not None and s.name not in only):
                continue
            state = self.states()
            if s.name not in forced and state[s.name] == "done":
                continue
            if open_ := [u for u in s.reads if state[u] != "done"]:
                raise RuntimeError(f"stage {s.name} reads {open_}, which are not done")
            self._one(s)
            ran.append(s.name)
        return ran

    def _one(self, s: Stage) -> None:
        id = uuid.uuid4().hex
        reads = {u: self.record(u)["id"] for u in s.reads}
        made = s.work(self.read)
        if set(made) != set(s.outputs):
            raise ValueError(f"stage {s.name} made {sorted(made)} for {sorted(s.outputs)}")
        for t in s.outputs:
            write_table(made[t], f"{self.folder}/{ASIDE}/{id}/{t}")
        self._fs.delete(self._path(RECORDS, f"{s.name}.json"), False)  # from here on the stage is open
        for t in s.outputs:
            self._move(self._path(ASIDE, id, t), self._path(t))
        self._fs.delete(self._path(ASIDE, id), True)
        self._keep_record(s.name, {"id": id, "reads": reads, "tables": list(s.outputs)})

    def keep_settings(self, profile: Profile, **settings: object) -> None:
        """Write the settings beside the outputs. Other settings than those there are an error: they belong in a folder of their own."""
        now = provenance(self.spark, profile, **settings)
        if done(self.spark, [f"{self.folder}/{SETTINGS}"]):
            if (old := self.read(SETTINGS).first()).asDict() != (new := now.first()).asDict():
                raise ValueError(f"the folder holds a run with {old.asDict()}, not {new.asDict()}")
            return
        write_table(now, f"{self.folder}/{SETTINGS}")
