"""Registered queries without SQL against plain loops over the same tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tables_and_trials import plain_linkage

from parley.operators import departments, ml, moments
from parley.plans import contact_queries, hotspot_queries, queries
from parley.settings import Settings
from parley.sources.readers import event_messages, topic_vectors


def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return [(r.vec_id, int(r.label), np.array(r.embedding, float)) for r in rows]


def test_crc_partitions(spark, sf):
    want = Counter(zlib.crc32(r.c_name.encode()) % 8 for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_name").collect())
    assert {r.part: r.n for r in queries.QUERIES["crc_partitions"](spark, sf).collect()} == want


@pytest.mark.parametrize("method", ["average", "complete"])
def test_linkage_merges(spark, sf, method):
    by, heat = defaultdict(list), Counter()
    for n, label, x in vectors(spark, sf):
        by[label].append(x)
        heat[label] += n % 3 + 1
    labels = sorted(by)
    groups = plain_linkage(np.array([np.mean(by[t], axis=0) for t in labels]), 0.05, method)
    want = {labels[i]: min((labels[j] for j in g), key=lambda t: (-heat[t], t)) for g in groups for i in g}
    assert {r.topic_id: r.canonical for r in queries.QUERIES[f"{method}_linkage_merge"](spark, sf).collect()} == want


def silhouette(x, part):
    """Mean over rows of (b - a) / max(a, b), from all pairs' squared distances."""
    gap = ((x[:, None] - x) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = part == part[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = gap[i][own].sum() / (own.sum() - 1)
        b = min(gap[i][part == p].mean() for p in set(part.tolist()) - {part[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_department_split(spark, sf):
    s = Settings()
    targets = {(r.department, r.topic_id) for r in hotspot_queries._drift(spark, sf).collect()}
    rows = hotspot_queries._slices(spark, sf).select("department", "topic_id", "session_id", "vector", "msg_count", "customer", F.xxhash64(F.col("session_id"), F.lit(s.seed)).alias("h")).collect()
    groups, volume, free = defaultdict(list), defaultdict(list), defaultdict(lambda: 10)
    for r in rows:
        groups[(r.department, r.topic_id)].append(r)
    split = 0
    for key in sorted(groups):
        own, best = sorted(groups[key], key=lambda r: (r.h, r.session_id)), None
        if key in targets:
            x = np.array([r.vector for r in own], float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for k in range(2, s.split_max_parts + 1):
                centers = departments._farthest(x, k)
                part = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
                sizes = np.bincount(part, minlength=k)
                quality = silhouette(x, part)
                if quality > 0 and min(n for n in sizes if n) >= max(s.department_min_sessions, math.ceil(len(x) * 0.1)) and (best is None or round(quality, 9) > best[0]):
                    best = (round(quality, 9), k, part)
        for i, r in enumerate(own):
            volume[(key[0], key[1] if best is None else free[key[0]] + int(best[2][i]), None if best is None else key[1])].append(r)
        if best is not None:
            free[key[0]] += best[1]
            split += 1
    want = sorted((*map(str, k), sum(r.msg_count for r in v), len(v), len({r.customer for r in v})) for k, v in volume.items())
    got = queries.QUERIES["department_split"](spark, sf).collect()
    assert split and sorted((*map(str, (r.department, r.topic_id, r.parent_topic_id)), r.heat, r.session_count, r.customer_count) for r in got) == want


def test_diverse_texts(spark, sf):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pools = defaultdict(list)
    for n, label, x in vectors(spark, sf):
        if n in docs:
            pools[label].append((hashlib.md5(str(n).encode()).hexdigest(), str(n), n, x / (np.linalg.norm(x) + 1e-9)))
    want = set()
    for label, pool in pools.items():
        pool = sorted(pool, key=lambda p: p[:2])[:40]
        centre = np.mean([p[3] for p in pool], axis=0)
        centre /= np.linalg.norm(centre) + 1e-9
        picked = []
        while len(picked) < min(8, len(pool)):
            score = lambda i: round(0.6 * float(pool[i][3] @ centre) - 0.4 * max([float(pool[i][3] @ pool[j][3]) for j in picked], default=0.0), 12)
            picked.append(max((i for i in range(len(pool)) if i not in picked), key=lambda i: (score(i), -i)))
        want |= {(label, k + 1, hashlib.md5(docs[pool[i][2]][:200].encode()).hexdigest()) for k, i in enumerate(picked)}
    assert {(r.topic_id, r.pick, r.text) for r in queries.QUERIES["diverse_texts"](spark, sf).collect()} == want


def plain_inertia(x, k, starts=8):
    best = np.inf
    for seed in range(starts):
        centers = moments.spread_centers(x, k, seed)
        for _ in range(50):
            own = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
            centers = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
        best = min(best, ((x - centers[own]) ** 2).sum())
    return best


@pytest.mark.parametrize("cluster", [ml.cluster_topics, moments.incremental_topics])
def test_clusterings_are_near_the_best_plain_one(spark, sf, cluster):
    s = Settings(clusters=10, pca_components=5)
    rows = topic_vectors(spark, sf).select("session_id", "vector")
    got = cluster(rows, s=s).collect()
    x = np.array([r.vector for r in got], float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    x = (x - x.mean(axis=0)) @ axes[:5].T
    own = np.array([r.topic_id for r in got])
    inertia = sum(((x[own == t] - x[own == t].mean(axis=0)) ** 2).sum() for t in set(own.tolist()))
    assert len(got) == rows.count() and inertia < 1.15 * plain_inertia(x, 10)
    assert sum(r.session_count for r in queries.QUERIES["kmeans_topics"](spark, sf).collect()) == sum(r.session_count for r in queries.QUERIES["incremental_topics"](spark, sf).collect()) == len(got)


def tokens(text):
    cjk = len(re.findall("[　-〿㐀-鿿＀-￯]", text))
    return math.ceil(round(0.7 * cjk + 0.35 * (len(text) - cjk), 6))


def test_transcripts(spark, sf):
    by = defaultdict(list)
    for r in event_messages(spark, sf).select("*", F.to_date("msg_time").alias("d"), F.date_format("msg_time", "HH:mm").alias("at")).collect():
        if body := " ".join(r.content.split()):
            by[(r.manager, r.customer, str(r.d))].append((r.msg_time, r.id, r.from_customer, body, r.at))
    want = []
    for key, rows in by.items():
        lines, last = [], None
        for _, _, who, body, at in sorted(rows):
            if who != last:
                lines.append(f"{at} {'客' if who else '经'}：{body}")
            else:
                lines[-1] += f" / {body}"
            last = who
        head = f"[{key[2]}]"
        if tokens(head + "\n" + "\n".join(lines)) <= 60:
            want += [(*key, k + 1, line) for k, line in enumerate(lines)]
            continue
        used = tokens(head) + 20
        for k, line in enumerate(lines):
            used += tokens(line) + 1
            if used > 60:
                break
            want.append((*key, k + 1, line))
        want.append((*key, (1 << 31) - 1, "（当天记录过长，后续内容已截断）"))
    got = queries.QUERIES["transcripts"](spark, sf).collect()
    assert sorted((r.manager, r.customer, str(r.stat_date), r.line_no, r.line) for r in got) == sorted(want)


def test_note_lines(spark, sf, monkeypatch):
    held = {}
    fitted = contact_queries.contacts.fitted_notes
    monkeypatch.setattr(contact_queries.contacts, "fitted_notes", lambda rows, budget: held.update(rows=rows, budget=budget) or fitted(rows, budget))
    got = queries.QUERIES["note_lines"](spark, sf).collect()
    pairs = defaultdict(list)
    for r in held["rows"].collect():
        pairs[(r.manager, r.customer)].append(r)

    def line(r, compact):
        parts = [f"{r.note_date:%m-%d}"] + (["话题：" + "、".join(r.topics)] if r.topics else [])
        return "｜".join(parts + ([] if compact else [f"{label}：" + "；".join(x) for label, x in (("客户", r.customer_points), ("经理", r.manager_actions), ("事实", r.facts)) if x]))

    want, shrunk = [], 0
    for key, rows in pairs.items():
        rows.sort(key=lambda r: r.note_date)
        shown = {r.note_date: line(r, False) for r in rows}
        cost = lambda: sum(tokens(x) + 1 for x in shown.values())  # noqa: E731, B023
        if cost() > held["budget"]:
            shrunk += 1
            shown |= {r.note_date: line(r, True) for r in rows if not r.priority}
            plain, marked = [r.note_date for r in rows if not r.priority], [r.note_date for r in rows if r.priority]
            for day in plain + marked[:-1]:
                if cost() <= held["budget"]:
                    break
                del shown[day]
        want += [(*key, d, x) for d, x in shown.items()]
    assert shrunk > 5 and sorted((r.manager, r.customer, r.note_date, r.line) for r in got) == sorted(want)


