"""Result tables under one root folder. What a run makes together becomes visible together (see versions)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import incremental
from parley.operators.incremental import read_if_there
from parley.sources.versions import Draft, Files, Scope, Version, union_of

SCHEMAS = {
    "vectors": "session_id string, staff string, customer string, msg_count long, text string, text_hash string, vector array<float>, config_fp string, stat_date string",
    "tokens": "session_id string, words array<string>, stat_date string",
    "moments": "i int, n long, mean array<double>, scatter array<double>, config_fp string, stat_date string",
    "assignments": "session_id string, staff string, topic_id int, run_id string, stat_date string",
    "centroids": "topic_id int, centroid array<double>, run_id string, stat_date string",
    "catalog": "topic_id int, customer_intent string, intent_source string, business_words array<string>, representative array<string>, words array<string>, run_id string, stat_date string",
    "boards": "rank int, topic_id int, parent_topic_id int, heat long, session_count long, customer_count long, score double, words array<string>, customer_intent string, intent_source string, business_words array<string>, representative array<string>, prev_topic int, prev_heat long, heat_change_pct double, is_new boolean, is_surge boolean, run_id string, stat_date string, scope_type string, scope_id string",
    "day_stats": "manager string, customer string, msg_count long, customer_msg_count long, manager_msg_count long, session_count long, customer_initiated long, first_msg_time timestamp, last_msg_time timestamp, source_fp string, stat_date date",
    "notes": "note_id string, manager string, customer string, note_date date, status string, source_fp string, prompt_version string, topics array<string>, customer_points array<string>, manager_actions array<string>, facts array<string>, pending array<string>, error string",
    "manifests": "records long, embed_fp string, token_fp string, source_fp string, run_id string, stat_date string",
    "signals": "note_id string, manager string, customer string, no int, code string, status string, evidence string, verified boolean, stat_date date",
    "summaries": "manager string, customer string, window_end date, session_count long, last_contact date, business_days long, incomplete_days long, signals array<struct<code:string,status:string>>, input_fp string, summary string, status string, error string",
    "text_vectors": "text_hash string, vector array<float>, config_fp string, stat_date string",
    "calls": "purpose string, manager string, customer string, batch long, days long, prompt_chars long, status string, attempts long, tokens long, error string, called_at timestamp",
    "stages": "run_id string, stat_date string, kind string, stage string, rows long, seconds double, least double, median double",
    "runs": "run_id string, stat_date string, kind string, status string, sessions long, topics long, error string",
}
#: Tables of a day's company run; the boards of all departments of a day are a scope of their own.
DAILY = ("vectors", "tokens", "moments", "assignments", "centroids", "catalog", "boards", "manifests")
#: Tables of the contact plan, merged by key in one commit.
CONTACTS = {
    "day_stats": ("manager", "customer", "stat_date"),
    "notes": ("manager", "customer", "note_date"),
    "signals": ("manager", "customer", "stat_date"),
    "summaries": ("manager", "customer", "window_end"),
}
_DAY = "stat_date="


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def scope(self, kind: str, date: str | None = None) -> Scope:
        """``company`` or ``departments`` of a day, or ``contacts``."""
        return Scope(self.spark, self.path(kind if date is None else f"{kind}/{_DAY}{date}"))

    def _days(self, kind: str) -> list[Scope]:
        return [Scope(self.spark, self.path(f"{kind}/{name}")) for name in Files(self.spark).folders(self.path(kind)) if name.startswith(_DAY)]

    def read(self, name: str, date: str | None = None) -> DataFrame:
        """A table as it is published now; ``date``: of one day."""
        if name in CONTACTS:
            return union_of([((s := self.scope("contacts")), s.current())], name, self.spark, SCHEMAS[name])
        if name == "text_vectors":
            return union_of([((s := self.scope("cache")), s.current())], name, self.spark, SCHEMAS[name])
        if name not in DAILY:
            rows = read_if_there(self.spark, self.path(name), SCHEMAS[name])
            return rows if date is None else rows.where(F.col("stat_date") == date)
        kinds = ("company", "departments") if name == "boards" else ("company",)
        scopes = [s for kind in kinds for s in ([self.scope(kind, date)] if date else self._days(kind))]
        return union_of([(s, s.current()) for s in scopes], name, self.spark, SCHEMAS[name])

    def aligned(self, name: str, rows: DataFrame, **values) -> DataFrame:
        """rows with the table's columns, those of ``values`` set, missing ones null."""
        rows = rows.withColumns({k: F.lit(v) for k, v in values.items()})
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns))

    def put(self, draft: Draft, name: str, rows: DataFrame, **values) -> DataFrame:
        return draft.write(name, self.aligned(name, rows, **values))

    def replace_day(self, name: str, rows: DataFrame, date: str) -> Version:
        """A new version of a day in which one table is replaced, also by nothing."""
        draft = self.scope("company", date).draft()
        draft.keep(*(t for t in (draft.old.tables if draft.old else ()) if t != name))
        self.put(draft, name, rows, stat_date=date)
        return draft.publish(**(draft.old.info if draft.old else {}))

    def append(self, name: str, rows: DataFrame) -> None:
        self.aligned(name, rows).write.mode("append").parquet(self.path(name))

    def written(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as files of their own below ``name``: an answer that was paid for is not asked for again when a task is lost."""
        path = f"{self.path(name)}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def manifest(self, date: str):
        """The day's manifest, if there is one and its vectors are as many as it says."""
        version = self.scope("company", date).current()
        found = self.read("manifests", date).first() if version else None
        return found if found is not None and found.records == version.rows("vectors") else None

    def reuse(self, date: str, embed_fp: str, token_fp: str) -> str:
        """What of a day may be used again: ``all``, ``vectors`` (only the words changed) or ``nothing``; by its manifest and its rows."""
        found = self.manifest(date)
        if found is None or found.embed_fp != embed_fp:
            return "nothing"
        return "all" if found.token_fp == token_fp else "vectors"

    def expire(self, name: str, before: str) -> list[str]:
        """Drops a table of all days that lie before, with its files; returns these days."""
        gone = []
        for scope in self._days("company"):
            date = scope.path.rsplit(_DAY, 1)[1]
            version = scope.current() if date < before else None
            if version and name in version.tables:
                draft = scope.draft()
                draft.keep(*(t for t in version.tables if t != name))
                draft.publish(**version.info)
                for path in version.paths(name):
                    Files(self.spark).remove(path)
                gone.append(date)
        return sorted(gone)

    def merge(self, rows: Mapping[str, DataFrame], rules: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None, **info) -> Version:
        """Puts rows of contact tables in by their keys, all in one commit; files without touched keys stay. By default new rows replace old ones."""
        draft = self.scope("contacts").draft()
        draft.keep(*CONTACTS)
        for name, new in rows.items():
            keys = CONTACTS[name]
            rule = (rules or {}).get(name) or (lambda old, new, keys=keys: incremental.upserted(old, new, keys))
            draft.merge(name, self.aligned(name, new), SCHEMAS[name], keys, rule)
        return draft.publish(**info)

    def cache_vectors(self, rows: DataFrame, before: str) -> None:
        """Keeps vectors of texts (text_hash, vector, config_fp, stat_date) for other days. Those last made before a date go, where a merge passes."""
        draft = self.scope("cache").draft()
        keys = ["text_hash", "config_fp"]
        draft.merge("text_vectors", self.aligned("text_vectors", rows.dropDuplicates(keys)), SCHEMAS["text_vectors"], ["text_hash"], lambda old, new: incremental.upserted(old.where(F.col("stat_date") >= before), new, keys))
        draft.publish()

    def log_calls(self, rows: DataFrame, purpose: str) -> None:
        """One row for each call of a model, never the prompt."""
        self.append("calls", rows.withColumn("purpose", F.lit(purpose)).withColumn("called_at", F.current_timestamp()))

    def save_notes(self, stats: DataFrame, notes: DataFrame, signals: DataFrame) -> Version:
        """Statistics, notes and their signals in one commit.

        A failed note only sets status, fingerprint and error where there was one before; its content and its signals
        stay. Any other note's signals of that day are replaced, also by none.
        """
        notes, signals = self.written("staged", self.aligned("notes", notes)), self.written("staged", self.aligned("signals", signals))
        keys = list(CONTACTS["notes"])
        failed: Column = F.col("status") == "failed"
        day = ["manager", "customer", "stat_date"]
        done = notes.where(~failed).select("manager", "customer", F.col("note_date").alias("stat_date"))
        signals = signals.join(done, day, "left_semi")
        # Days whose signals are replaced by none touch their bucket too: they come as rows without a code, which the rule drops.
        emptied = done.join(signals.select(*day).distinct(), day, "left_anti")
        rows = {"day_stats": stats, "notes": notes, "signals": self.aligned("signals", signals).unionByName(self.aligned("signals", emptied))}
        made = self.merge(rows, {
            "notes": lambda old, new: incremental.patched(old, new, keys, failed, ["status", "source_fp", "error"]),
            "signals": lambda old, new: old.join(new.select(*day).distinct(), day, "left_anti").unionByName(new.where("code IS NOT NULL")),
        })
        Files(self.spark).remove(self.path("staged"))
        return made

    def save_summaries(self, summaries: DataFrame) -> Version:
        """Summaries by pair and window. A failed one keeps the summary there was and sets status and error."""
        keys = list(CONTACTS["summaries"])
        return self.merge({"summaries": summaries}, {"summaries": lambda old, new: incremental.patched(old, new, keys, F.col("status") == "failed", ["status", "error"])})
