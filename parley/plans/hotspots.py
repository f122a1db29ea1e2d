"""The daily plans: sessions to a ranked board, and the same by department."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from datetime import date as day
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parley.functions.hashing import config_fingerprint
from parley.functions.segment import segmented
from parley.functions.text import business_tokens, tokens
from parley.operators import departments, moments, sessions, topics, trend
from parley.plans import intents
from parley.plans.providers import Embed, cacheable, embedded, hashing_embedder
from parley.settings import DEFAULTS, Settings
from parley.sources.readers import customer_messages, union_of_shards
from parley.sources.tables import SCHEMAS, Store
from parley.sources.versions import Draft, Scope


def _day_before(date: str, days: int = 1) -> str:
    return str(day.fromisoformat(date) - timedelta(days=days))


def session_units(log: DataFrame, date: str, chitchat: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Masked session texts of customers on a day."""
    kept = sessions.keep_messages(customer_messages(log, date, s), chitchat, s)
    return sessions.aggregate_sessions(sessions.sessionize(kept, ["staff", "customer"], s=s), ["staff", "customer"])


def words_of(dictionary: Mapping[str, int] | Iterable[str] | None = None, han: bool = False, stop: Iterable[str] = ()) -> tuple[Callable[[Column], Column], str]:
    """How texts are cut into words, and the fingerprint of that: by a dictionary of Han words, or at white space."""
    if dictionary is not None:
        counts = dict(dictionary) if isinstance(dictionary, Mapping) else dict.fromkeys(dictionary, 1)
        cut = lambda text: business_tokens(segmented(text, counts))
        config = {"dictionary": sorted(counts.items())}
    else:
        cut, config = (lambda text: business_tokens(tokens(text), han=han)), {"han": han}
    gone = sorted(set(stop))
    if not gone:
        return cut, config_fingerprint(config)
    return (lambda text: F.filter(cut(text), lambda w: ~w.isin(gone))), config_fingerprint(config | {"stop": gone})


def _words(rows: DataFrame, words: DataFrame, by: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """The hot words of each topic; rows: by…, session_id; words: session_id, words."""
    terms = topics.term_counts(rows.select(*by, "session_id").join(words, "session_id"), F.col("words"), by)
    top = topics.class_tfidf(terms, within=within)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))


def _board(volume: DataFrame, words: DataFrame, by: list[str], s: Settings) -> DataFrame:
    rows = topics.ranked(volume, [c for c in by if c != "topic_id"], s=s).join(words, by, "left")
    return rows.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def _recorded(store: Store, run: str, date: str, kind: str, status: str, sessions: int = 0, topics: int = 0, error: str | None = None) -> None:
    store.append("runs", store.spark.createDataFrame([(run, date, kind, status, sessions, topics, error)], SCHEMAS["runs"]))


class Run:
    """A run's id, and what it notes on the way."""

    def __init__(self, store: Store, date: str, kind: str):
        self.store, self.date, self.kind, self.id, self.drafts, self.seen = store, date, kind, uuid.uuid4().hex, [], {}

    def draft(self, scope: Scope) -> Draft:
        self.drafts.append(scope.draft())
        return self.drafts[-1]

    def observed(self, stage: str) -> Observation:
        """An observation whose n, least and median are noted under this stage."""
        self.seen[stage] = Observation()
        return self.seen[stage]

    def note(self) -> None:
        """Rows and seconds of every table that was written, and what was observed: counted in the jobs that ran anyway."""
        rows = [(self.id, self.date, self.kind, table, n, seconds, None, None) for d in self.drafts for table, n, seconds in d.stages]
        rows += [(self.id, self.date, self.kind, stage, x["n"], None, x["least"], x["median"]) for stage, o in self.seen.items() if (x := o.get)]
        if rows:
            self.store.append("stages", self.store.spark.createDataFrame(rows, SCHEMAS["stages"]))


@contextmanager
def _run(store: Store, date: str, kind: str) -> Iterator[Run]:
    """A run that fails leaves a row that says why, and the stages that it got through; its draft is never published."""
    run = Run(store, date, kind)
    try:
        yield run
    except Exception as e:
        run.seen = {}  # what did not run to its end was not observed
        run.note()
        _recorded(store, run.id, date, kind, "failed", error=f"{type(e).__name__}: {e}"[:500])
        raise
    run.note()


def _source_fingerprint(units: DataFrame) -> tuple[int, str]:
    """Number and fingerprint of the session texts, in any order."""
    h = F.xxhash64("session_id", "text_hash", "msg_count", "staff", "customer")
    r = units.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("s")).first()
    return r.n, f"{r.n}:{r.x}:{r.s}"


def run_daily(
    store: Store, log: DataFrame, date: str, embed: Embed = hashing_embedder, chitchat: DataFrame | None = None, han: bool = False, force: bool = False, embed_config: dict | None = None, s: Settings = DEFAULTS,
    dictionary: Mapping[str, int] | Iterable[str] | None = None, stop: Iterable[str] = (), provider: Callable[[list[str]], list[str]] | None = None,
) -> str:
    """Computes and publishes the company's board of a day, and returns its run id.

    All tables of the run become visible together, by a pointer that is written last; a run that dies leaves the day as it
    was. The manifest says by what configuration vectors and words were made, and of which texts. Of equal texts under
    the same ``embed_config`` the vectors are not written again, so that a change of ``dictionary`` or ``stop`` words
    costs the words alone; else those texts are embedded that no earlier version of the day had, and no other day if they
    are short enough to be cached. ``force`` embeds all.
    ``provider`` words the topics' intents; without one they are made of the hot words. An empty day is published empty.
    """
    with _run(store, date, "company") as run:
        units = session_units(log, date, chitchat, s)
        cut, token_fp = words_of(dictionary, han, stop)
        embed_fp = config_fingerprint(embed_config or {"model": "hashing"})
        scope = store.scope("company", date)
        draft, old = run.draft(scope), None if force else store.manifest(date)
        same = {"stat_date": date, "run_id": run.id}
        n, source_fp = _source_fingerprint(units)
        known = old is not None and old.embed_fp == embed_fp
        if known and old.source_fp == source_fp:
            draft.keep("vectors", "moments", *(["tokens"] if old.token_fp == token_fp else []))
            rows = scope.read(draft.old, "vectors", SCHEMAS["vectors"])
        else:
            cache = None if force else store.read("text_vectors").where(F.col("config_fp") == embed_fp).select("text_hash", "vector")
            if known:
                cache = cache.unionByName(scope.read(draft.old, "vectors", SCHEMAS["vectors"]).select("text_hash", "vector"))
            rows = store.put(draft, "vectors", embedded(units, embed, None if cache is None else cache.dropDuplicates(["text_hash"]), s=s), config_fp=embed_fp, stat_date=date)
            short = rows.where(cacheable(F.col("text"), s))
            if not short.isEmpty():
                store.cache_vectors(short, _day_before(date, s.cache_days))
        if "tokens" in draft.tables:
            words = scope.read(draft.old, "tokens", SCHEMAS["tokens"])
        else:
            words = store.put(draft, "tokens", rows.select("session_id", cut(F.col("text")).alias("words")), stat_date=date)
        if "moments" not in draft.tables:
            store.put(draft, "moments", moments.moments(rows), config_fp=embed_fp, stat_date=date)
        days = [scope.read(draft.made(), "moments", SCHEMAS["moments"]), *(store.read("moments", _day_before(date, k)).where(F.col("config_fp") == embed_fp) for k in range(1, s.moment_days))]
        sketch = days[0] if len(days) == 1 else moments.merged_moments(union_of_shards(days))
        # The clustering is written once, with the topics before merging; all that follows reads it.
        clustered = topics.without_noise(moments.incremental_topics(rows, sketch, s=s)).select("session_id", "staff", "customer", "msg_count", F.col("topic_id").cast("int").alias("topic_id"))
        clustered = draft.write("clustered", clustered)  # noise, by the settings' gates, is on no board
        vectors = rows.select("session_id", "vector", "text")
        mapping = topics.merge_map(topics.topic_volume(clustered), topics.packed(topics.centroids(clustered.join(vectors, "session_id"))), s=s)
        final = topics.canonical_sessions(clustered.withColumn("member", F.col("topic_id")), mapping)
        final = draft.write("members", final)
        full = final.join(vectors, "session_id")
        board = _board(topics.topic_volume(final), _words(final, words, ["topic_id"]), ["topic_id"], s)
        board = board.join(intents.described(board, intents.pool(full, s), provider, s), "topic_id").withColumn("parent_topic_id", F.lit(None).cast("int"))
        board = draft.write("ranked", board)  # an intent that was paid for is not asked for again
        before = store.read("boards", _day_before(date)).where("scope_type = 'global'").select("topic_id", "rank", "heat", "words")
        shown = trend.with_trend(board.where(F.col("rank") <= s.top_n), before, s=s)
        store.put(draft, "assignments", final, **same)
        store.put(draft, "centroids", topics.packed(topics.centroids(full)), **same)
        store.put(draft, "catalog", board, **same)
        store.put(draft, "boards", shown, **same, scope_type="global", scope_id="all")
        store.put(draft, "manifests", store.spark.createDataFrame([(draft.tables["vectors"]["rows"], embed_fp, token_fp, source_fp)], "records long, embed_fp string, token_fp string, source_fp string"), **same)
        found = draft.tables["ranked"]["rows"]
        draft.drop("clustered", "members", "ranked")
        draft.publish(run_id=run.id)
        _recorded(store, run.id, date, "company", "success", n, found)
    return run.id


def run_departments(
    store: Store, roster: DataFrame, date: str, han: bool = False, s: Settings = DEFAULTS, provider: Callable[[list[str]], list[str]] | None = None,
) -> DataFrame:
    """Boards of all the roster's departments in one job; returns (department, topics) of what was published.

    Needs the artifacts and the catalog of one and the same company run, and reads that version throughout. All boards
    become visible together: those of the roster's departments are replaced, also by none; others stay. ``provider``
    words the intents of topics that the company's catalog lacks.
    """
    scope = store.scope("company", date)
    version = scope.current()
    assignments, catalog = (scope.read(version, t, SCHEMAS[t]) for t in ("assignments", "catalog"))
    if version is None or not departments.is_ready(assignments, catalog):
        raise ValueError(f"{date} has no company run to slice")
    company_run = version.info["run_id"]
    with _run(store, date, "departments") as run:
        vectors = scope.read(version, "vectors", SCHEMAS["vectors"]).drop("staff", "config_fp", "stat_date")
        words = scope.read(version, "tokens", SCHEMAS["tokens"])
        sliced = departments.sliced(vectors.join(assignments.select("session_id", "staff", "topic_id"), "session_id"), roster)
        by = ["department", "topic_id"]
        local = topics.topic_volume(sliced, by).join(topics.packed(topics.centroids(sliced, by), by), by)
        targets = departments.drifted(local, scope.read(version, "centroids", SCHEMAS["centroids"]), s, run.observed("drift"))
        free = (catalog.agg(F.max("topic_id")).first()[0] or 0) + 1
        ours = store.scope("departments", date)
        draft = run.draft(ours)
        final = draft.write("members", departments.split_targets(sliced, targets, free, s))
        volume = departments.above_floor(topics.topic_volume(final, [*by, "parent_topic_id"]), s).drop("total", "floor")
        board = _board(volume, _words(final, words, by, ("department",)), by, s).where(F.col("rank") <= s.top_n)
        company = catalog.select(F.col("topic_id").alias("_topic"), "business_words", "representative")
        board = departments.with_fallback(board, catalog)
        board = board.join(company, F.coalesce("parent_topic_id", "topic_id") == F.col("_topic"), "left").drop("_topic")
        if provider is not None:
            own = board.where("intent_source = 'department'").drop("customer_intent", "intent_source", "business_words", "representative")
            pool = intents.pool(final.withColumn("member", F.col("topic_id")).join(own.select(*by), by, "left_semi"), s, by)
            board = board.where("intent_source <> 'department'").unionByName(own.join(intents.described(own, pool, provider, s, by), by))
        board = draft.write("ranked", board.withColumnRenamed("department", "scope_id"))
        before = store.read("boards", _day_before(date)).where("scope_type = 'department'").select("scope_id", "topic_id", "rank", "heat", "words")
        shown = trend.with_trend(board, before, ["scope_id"], s)
        shown = store.aligned("boards", shown, run_id=company_run, stat_date=date, scope_type="department")
        others = ours.read(draft.old, "boards", SCHEMAS["boards"]).join(roster.select(F.col("department").cast("string").alias("scope_id")).distinct(), "scope_id", "left_anti")
        published = draft.write("boards", shown.unionByName(others))
        draft.drop("members", "ranked")
        draft.publish(run_id=company_run)
        found = published.join(roster.select(F.col("department").cast("string").alias("scope_id")).distinct(), "scope_id", "left_semi").groupBy(F.col("scope_id").alias("department")).agg(F.count("*").alias("topics"))
        return store.spark.createDataFrame([(r.department, r.topics) for r in found.collect()], "department string, topics long")  # a company's departments


def assigned(store: Store, date: str, staff: DataFrame | None = None) -> DataFrame:
    """(session_id, staff, topic_id) of a day's published run; of the managers in ``staff`` (column staff) alone, if given."""
    rows = store.read("assignments", date).select("session_id", "staff", "topic_id")
    return rows if staff is None else rows.join(staff.select("staff").distinct(), "staff", "left_semi")


def board(store: Store, date: str, kind: str = "global", scope: str = "all") -> DataFrame:
    """A published board in order of rank."""
    rows = store.read("boards", date).where((F.col("scope_type") == kind) & (F.col("scope_id") == scope))
    return rows.orderBy("rank")


def run_of(store: Store, run_id: str) -> DataFrame:
    """One run's row."""
    return store.read("runs").where(F.col("run_id") == run_id)


def stages(store: Store, run_id: str) -> DataFrame:
    """What a run noted: rows and seconds of each table it wrote, distributions that it observed."""
    return store.read("stages").where(F.col("run_id") == run_id).drop("run_id")


def runs(store: Store, limit: int = 100) -> DataFrame:
    return store.read("runs").orderBy(F.desc("stat_date"), "run_id").limit(limit)
