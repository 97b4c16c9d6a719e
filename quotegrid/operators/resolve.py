"""Entity resolution: the same show across sources.

Records: rec_id (their order), source, source_id, title_raw, venue_raw, url,
description. ``normalized`` adds title_norm, venue_norm, venue_canonical.
Clusters are a column: cluster_id, the smallest rec_id of the cluster.

Every step that several others read is a stage: written once, so the plans of the
steps after it start at its files and don't grow with the chain.

Pairs of titles meet at the rarest token that they share, and only if the gate
can let them pass (``title_keys``); what can't reach the score by its lengths is
dropped before any letter is compared. What is sequential by nature (a merge
forbids later ones) runs over one component of the pairs that may merge.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..functions.registry import FUZZY_AUTO, FUZZY_REVIEW, LEAST_SHARED_CHARS, RESCUE_MARGIN, RESCUE_SCORE, SOURCE_PRIORITY, VENUE_ALIASES
from ..sources.session import stage
from .offers import ranked, top
from .spread import HOT_ROWS, components, dealt_join, first_shared, hot_keys

c = F.col
NO_VENUE = "Unknown Venue"


def priority(source: Column) -> Column:
    """A source's place in the order of preference; unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCE_PRIORITY)), source), F.lit(0)).cast("int"), F.lit(999))


def normalized(records: DataFrame) -> DataFrame:
    """Mended texts and the keys of title and venue, without moving a row."""
    mended = records.withColumns({k: text.mend(c(k)) for k in ("title_raw", "venue_raw", "description") if k in records.columns})
    venues = mended.withColumn("__v", text.normalize_venue(c("venue_raw")))
    return venues.withColumns({"venue_norm": c("__v.venue_norm"), "venue_canonical": c("__v.venue_canonical")}).drop("__v").withColumn("title_norm", text.normalize_title(c("title_raw"), c("venue_norm")))


def exact_clusters(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with cluster_id by equal title and venue keys, and the orphans that lack one of them."""
    has = (c("title_norm") != "") & c("venue_norm").isNotNull()
    rows = stage(records)
    named = rows.where(has)
    ids = named.groupBy("title_norm", "venue_norm").agg(F.min("rec_id").alias("cluster_id"))
    return stage(named.join(ids, ["title_norm", "venue_norm"])), rows.where(~F.coalesce(has, F.lit(False)))


def _tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(title, " "), lambda t: t != ""))


def title_tokens(titles: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``titles`` (title, and other columns) with ``tokens``, rare ones first: those
    that many distinct titles have stand last, by their number; the rest by letters."""
    words = titles.select("title").distinct().select("title", F.explode(_tokens(c("title"))).alias("token"))
    hot = hot_keys(words, ["token"], hot_rows)
    if hot is None:
        return titles.withColumn("tokens", F.array_sort(_tokens(c("title"))))
    placed = words.join(F.broadcast(hot), "token", "left")
    ordered = placed.groupBy("title").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("t"))
    return titles.join(ordered.select("title", F.transform("t", lambda x: x["token"]).alias("tokens")), "title")


def title_keys(tokens: Column) -> Column:
    """The tokens under which a title meets others. The gate wants two shared
    tokens, or one of six letters: so the rarest shared token is not the last one of
    either title, or it is long. A common short word is the last of most titles that
    have it, and there it brings nobody together."""
    return F.filter(tokens, lambda t, i: (i < F.size(tokens) - 1) | (F.length(t) >= LEAST_SHARED_CHARS))


def candidates(left: DataFrame, right: DataFrame, on: list[str], least: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (``on``, a_id, a_title, b_id, b_title) of (id, title, tokens) that
    agree in ``on`` and may score so much, each once: at the rarest token they share."""
    a, b = (df.select(*on, c("id").alias(f"{x}_id"), c("title").alias(f"{x}_title"), c("tokens").alias(f"{x}_tokens"), F.explode(title_keys(c("tokens"))).alias("key")) for df, x in ((left, "a"), (right, "b")))
    joined = dealt_join(a, b, [*on, "key"], hot_rows)
    own = joined.where((c("a_id") != c("b_id")) & (first_shared(c("a_tokens"), c("b_tokens")) == c("key")))
    return own.where(similarity.may_score(c("a_tokens"), c("b_tokens"), least)).drop("key", "a_tokens", "b_tokens")


def scored_pairs(left: DataFrame, right: DataFrame, on: list[str], least: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (a_id, a_title, b_id, b_title, score) of (id, title) that agree in
    ``on`` and score at least so much; ids of the two sides that are equal don't meet."""
    both = stage(title_tokens(left.withColumn("__a", F.lit(True)).unionByName(right.withColumn("__a", F.lit(False))), hot_rows))
    pairs = candidates(both.where("__a").drop("__a"), both.where("not __a").drop("__a"), on, least, hot_rows)
    return pairs.withColumn("score", similarity.score_udf("a_title", "b_title")).where(c("score") >= least)


def gate_pairs(titles: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of (id, title) that agree in ``on`` and pass the gate, the smaller id first; nothing is scored."""
    found = stage(title_tokens(titles, hot_rows))
    return candidates(found, found, on, 0, hot_rows).where("a_id < b_id")


def fuzzy_edges(clustered: DataFrame, least: int = FUZZY_REVIEW, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Scored pairs of a venue's cluster titles, the earlier cluster first."""
    titles = clustered.select("venue_norm", c("cluster_id").alias("id"), c("title_norm").alias("title")).distinct()
    found = stage(title_tokens(titles, hot_rows))
    pairs = candidates(found, found, ["venue_norm"], least, hot_rows).where("a_id < b_id")
    return pairs.withColumn("score", similarity.score_udf("a_title", "b_title")).where(c("score") >= least)


def _greedy(key: tuple, edges: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Best edges first; two clusters with a source in common never become one."""
    up: dict[int, int] = {int(i): int(i) for i in members["cluster_id"]}
    sources = {i: set(s) for i, s in members.groupby("cluster_id")["source"]}
    rows = []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in edges.sort_values(["score", "a_id", "b_id"], ascending=[False, True, True]).itertuples():
        a, b = root(int(e.a_id)), root(int(e.b_id))
        if a == b:
            continue
        if sources[a] & sources[b]:
            fate = "blocked"
        else:
            fate, up[a] = "merged", b
            sources[b] = sources[b] | sources.pop(a)
        rows.append((int(e.a_id), int(e.b_id), e.venue_norm, e.a_title, e.b_title, int(e.score), fate))
    least: dict[int, int] = {}
    for i in sorted(up):
        least.setdefault(root(i), i)
    rows += [(i, least[root(i)], None, None, None, None, None) for i in up]
    return pd.DataFrame(rows, columns=["a_id", "b_id", "venue_norm", "a_title", "b_title", "score", "fate"])


MERGE_SCHEMA = "a_id long, b_id long, venue_norm string, a_title string, b_title string, score int, fate string"


def fuzzy_merge(clustered: DataFrame, auto: int = FUZZY_AUTO, review: int = FUZZY_REVIEW) -> tuple[DataFrame, DataFrame]:
    """Records with merged cluster_ids, and the log of pairs (merged, blocked, review).

    Only pairs from ``auto`` on merge, so their components are decided apart, best
    pair first, with each cluster's sources once. Pairs below come after all merges:
    they are for review unless both sides are one cluster by then.
    """
    edges = stage(fuzzy_edges(clustered, review))
    strong = edges.where(c("score") >= auto)
    place = components(strong.select(c("a_id").alias("a"), c("b_id").alias("b")))
    own = strong.join(place.select(c("node").alias("a_id"), "label"), "a_id")
    members = clustered.select("cluster_id", "source").distinct().join(place.select(c("node").alias("cluster_id"), c("label").alias("part")), "cluster_id")
    out = stage(own.groupBy("label").cogroup(members.groupBy("part")).applyInPandas(_greedy, MERGE_SCHEMA))
    moved = out.where("fate is null and a_id <> b_id")
    to = lambda x: moved.select(c("a_id").alias(x), c("b_id").alias(f"__{x}"))
    weak = edges.where(c("score") < auto).join(to("a_id"), "a_id", "left").join(to("b_id"), "b_id", "left").where(F.coalesce("__a_id", "a_id") != F.coalesce("__b_id", "b_id"))
    merged = clustered.join(to("cluster_id"), "cluster_id", "left").withColumn("cluster_id", F.coalesce("__cluster_id", "cluster_id")).drop("__cluster_id")
    names = ["venue_norm", c("a_title").alias("title_a"), c("b_title").alias("title_b"), "score"]
    return stage(merged), out.where("fate is not null").select(*names, "fate").unionByName(weak.select(*names, F.lit("review").alias("fate")))


def rescue(clustered: DataFrame, orphans: DataFrame, least: int = RESCUE_SCORE, margin: int = RESCUE_MARGIN) -> tuple[DataFrame, DataFrame]:
    """Orphans attached by title alone, and the log of all decisions.

    An orphan goes to its best cluster unless another scores within the margin,
    the cluster has a record of its source, or an earlier orphan of its source took the place.
    """
    wanted = orphans.where("title_norm <> ''")
    names = [x.select(c("title_norm").alias("title")).distinct() for x in (wanted, clustered)]
    pairs = scored_pairs(*(x.select("title", F.concat(F.lit(side), "title").alias("id")) for x, side in zip(names, "oc")), [], least)
    # each merged-in title names its cluster; what is best depends on an orphan's title only
    clusters = clustered.groupBy("cluster_id", c("title_norm").alias("b_title")).agg(F.count("*").alias("n"))
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("size"))
    found = pairs.select("a_title", "b_title", "score").join(clusters.drop("n"), "b_title").groupBy(c("a_title").alias("title_norm"), "cluster_id").agg(F.max("score").alias("score")).join(sizes, "cluster_id")
    order = [F.desc("score"), F.desc("size"), c("cluster_id")]
    two = top(found, ["title_norm"], order, 2, "n").withColumn("next", F.when(c("n") == 2, c("score")))
    best = two.groupBy("title_norm").agg(F.min_by("cluster_id", "n").alias("cluster_id"), F.min_by("score", "n").alias("score"), F.max("next").alias("next"))
    held = clustered.select("cluster_id", "source").distinct().withColumn("held", F.lit(True))
    decided = wanted.select("rec_id", "source", "title_norm").join(best, "title_norm", "left").join(held, ["cluster_id", "source"], "left")
    status = F.when(c("score").isNull(), "no_match_above_threshold").when(c("next") >= c("score") - margin, "blocked_ambiguous_match").when(c("held"), "blocked_within_source_duplicate").otherwise("attached")
    judged = stage(decided.withColumn("status", status).select("rec_id", "source", "cluster_id", "score", "status"))
    first = judged.where("status = 'attached'").groupBy("cluster_id", "source", "status").agg(F.min("rec_id").alias("first"))
    log = judged.join(first, ["cluster_id", "source", "status"], "left").withColumn("status", F.when(c("first") < c("rec_id"), "blocked_within_source_duplicate").otherwise(c("status")))
    log = log.select("rec_id", "cluster_id", "score", "status").unionByName(orphans.where("coalesce(title_norm, '') = ''").select("rec_id", F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("int").alias("score"), F.lit("no_title_norm").alias("status")))
    donor = clustered.groupBy("cluster_id").agg(F.min_by(F.struct("venue_norm", "venue_canonical"), "rec_id").alias("d"))
    taken = log.where("status = 'attached'").join(donor, "cluster_id").select("rec_id", "cluster_id", c("d.venue_norm").alias("__vn"), c("d.venue_canonical").alias("__vc"))
    attached = orphans.join(taken, "rec_id").withColumns({"venue_norm": c("__vn"), "venue_canonical": c("__vc")}).select(*clustered.columns)
    return stage(clustered.unionByName(attached)), log


def override(clustered: DataFrame, rules: Mapping) -> tuple[DataFrame, list[dict]]:
    """Manual rules: ``force_split`` first (a record becomes a cluster of its own),
    then ``force_merge`` (records move to the cluster that holds most of them, or,
    for a single one, to the cluster of a canonical title and venue).

    The driver holds the named records, their clusters' sizes and the rules.
    """
    splits, merges = list(rules.get("force_split") or []), list(rules.get("force_merge") or [])
    named = {(r.get("source"), str(r.get("source_id", ""))) for s in splits if (r := s.get("record"))} | {(r.get("source"), str(r.get("source_id", ""))) for m in merges for r in m.get("records") or []}
    log: list[dict] = []
    if not named:
        return clustered, [{"action": "force_merge", "status": "needs_at_least_1_record"} for _ in merges]
    spark = clustered.sparkSession
    wanted = spark.createDataFrame(sorted(named), "source string, source_id string")
    found = {(r.source, r.source_id): [r.rec_id, r.cluster_id] for r in clustered.join(F.broadcast(wanted), ["source", "source_id"]).select("source", "source_id", "rec_id", "cluster_id").collect()}
    touched = spark.createDataFrame([(x,) for x in sorted({v[1] for v in found.values()})], "cluster_id long")
    sizes = {r[0]: r[1] for r in clustered.join(F.broadcast(touched), "cluster_id").groupBy("cluster_id").count().collect()}
    moves: dict[int, int] = {}

    def move(rid: tuple[str, str], to: int) -> None:
        rec, was = found[rid]
        sizes[was] -= 1
        sizes[to] = sizes.get(to, 0) + 1
        found[rid][1] = moves[rec] = to

    for s in splits:
        r = s.get("record")
        if not r:
            continue
        rid = (r.get("source"), str(r.get("source_id", "")))
        if rid not in found:
            log.append({"action": "force_split", "status": "record_not_found", **r})
            continue
        move(rid, -found[rid][0] - 1)  # a number that no cluster has
        log.append({"action": "force_split", "status": "applied", "record": r})
    for m in merges:
        ids = [(r.get("source"), str(r.get("source_id", ""))) for r in m.get("records") or []]
        have = [i for i in dict.fromkeys(ids) if i in found]
        if not ids:
            log.append({"action": "force_merge", "status": "needs_at_least_1_record"})
        elif not have:
            log.append({"action": "force_merge", "status": "no_records_found"})
        else:
            to = _destination(clustered, m, have, found, sizes, moves)
            if to is None:
                log.append({"action": "force_merge", "status": "no_destination_cluster_found"})
                continue
            going = [i for i in have if found[i][1] != to]
            for i in going:
                move(i, to)
            log.append({"action": "force_merge", "status": "applied" if going else "no_op_already_merged", "records_moved": len(going)})
    if not moves:
        return clustered, log
    table = spark.createDataFrame(sorted(moves.items()), "rec_id long, __to long")
    return clustered.join(F.broadcast(table), "rec_id", "left").withColumn("cluster_id", F.coalesce("__to", "cluster_id")).drop("__to"), log


def _destination(clustered, rule, have, found, sizes, moves) -> int | None:
    if len(have) > 1:
        votes: dict[int, int] = {}
        for i in have:
            votes[found[i][1]] = votes.get(found[i][1], 0) + 1
        return max(votes, key=lambda k: (votes[k], sizes.get(k, 0)))
    if not (rule.get("canonical_title") and rule.get("canonical_venue")):
        return None
    venue, _ = text.venue_key(rule["canonical_venue"])
    title = text.title_key(rule["canonical_title"], venue)
    rows = clustered.where((c("title_norm") == title) & (c("venue_norm") == venue)).groupBy("cluster_id").agg(F.min("rec_id")).orderBy("cluster_id").limit(2).collect()
    own = found[have[0]][1]
    return next((r[0] for r in rows if r[0] != own or sizes.get(own, 0) > 1), None)


def picked_titles(members: DataFrame) -> DataFrame:
    """For each cluster the title that most records have, without their venue at
    its end; of equals one that doesn't shout, the shortest, the preferred source's, the first by letters."""
    raw, venue = F.trim(c("title_raw")), c("venue_canonical")
    ends = [F.concat(F.lit(x), venue) for x in (" - ", " - The ")]
    title = raw
    for e in reversed(ends):
        title = F.when(F.endswith(F.lower(raw), F.lower(e)), F.trim(F.substring(raw, F.lit(1), F.length(raw) - F.length(e)))).otherwise(title)
    votes = members.withColumn("title", title).where("title <> ''").groupBy("cluster_id", "title").agg(F.count("*").alias("votes"), F.min(F.struct(priority(c("source")).alias("p"), "source")).alias("s"))
    order = F.struct(-c("votes"), text.shouting(c("title")), F.length("title"), c("s.p"), c("title"))
    return votes.groupBy("cluster_id").agg(F.min_by(F.struct("title", c("s.source").alias("source")), order).alias("x")).select("cluster_id", "x.title", c("x.source").alias("title_source"))


def _longest(column: str) -> Column:
    """Of a group, the longest text that isn't blank with its source; of equals the preferred source's."""
    key = F.struct(F.length(column), -priority(c("source")), -c("rec_id"))
    return F.max_by(F.struct(column, "source"), F.when(F.trim(c(column)) != "", key))


def longest_texts(members: DataFrame, column: str = "description", by: str = "cluster_id") -> DataFrame:
    """For each cluster the longest text that isn't blank; of equals the preferred source's."""
    ok = members.where(F.trim(c(column)) != "")
    return ok.groupBy(by).agg(_longest(column).alias("x")).select(by, c(f"x.{column}").alias(column), c("x.source").alias(f"{column}_source"))


def _venue_names() -> list[Column]:
    """Of a group, the first venue of the registry (k), and the first of all (f)."""
    known = c("venue_canonical").isin(*VENUE_ALIASES)
    return [F.min_by("venue_canonical", F.when(known, c("rec_id"))).alias("k"), F.min_by("venue_canonical", F.when(c("venue_canonical").isNotNull(), c("rec_id"))).alias("v")]


def _shown_venue() -> dict[str, Column]:
    return {"venue": F.coalesce("k", "v", F.lit(NO_VENUE)), "venue_source": F.when(c("k").isNotNull(), "registry").otherwise("first_source")}


def display_venues(members: DataFrame) -> DataFrame:
    """The first name of the registry, else the first name, else a fixed one."""
    return members.groupBy("cluster_id").agg(*_venue_names()).withColumns(_shown_venue()).drop("k", "v")


def build_shows(members: DataFrame, perfs: DataFrame, least_performances: int = 0) -> DataFrame:
    """One row for each cluster, in the final order (``show_ord``): more records
    first, then by title. ``perfs`` are unified performances by cluster_id."""
    first = members.groupBy("cluster_id").agg(
        F.min_by(F.struct("title_norm", "venue_norm"), "rec_id").alias("f"), F.count("*").alias("record_count"), F.size(F.collect_set("source")).cast("long").alias("source_count"), _longest("description").alias("t"), *_venue_names()
    )
    sums = perfs.groupBy("cluster_id").agg(F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"), F.count("*").alias("performance_count"))
    joined = first.join(picked_titles(members), "cluster_id", "left").join(sums, "cluster_id", "left").withColumns({"performance_count": F.coalesce("performance_count", F.lit(0)), "description": c("t.description"), "description_source": c("t.source"), **_shown_venue()}).where(c("performance_count") >= least_performances)
    ids = text.show_id(F.coalesce(c("f.title_norm"), F.lit("")), F.coalesce(c("f.venue_norm"), F.lit("")))
    split = F.when(c("cluster_id") < 0, F.concat(ids, F.lit("-split-"), (-c("cluster_id") - 1).cast("string"))).otherwise(ids)  # split records keep their keys, so their ids need more
    title = F.lower(F.coalesce("title", F.lit("")))
    placed = ranked(stage(joined), [-c("record_count"), F.substring(title, 1, 3)], [title, c("cluster_id")], "show_ord")
    return placed.select("show_ord", split.alias("show_id"), "cluster_id", F.coalesce("title", F.lit("")).alias("title"), "venue", c("f.title_norm").alias("title_norm"), c("f.venue_norm").alias("venue_norm"), "record_count", "source_count", "description", "min_price", "max_price", "performance_count", F.create_map(F.lit("title"), c("title_source"), F.lit("description"), c("description_source"), F.lit("venue"), c("venue_source")).alias("field_provenance"), F.lit(100).alias("match_confidence"))


def source_rows(members: DataFrame) -> DataFrame:
    """The records of each cluster in the order of preference, with the confidence of how they got there."""
    via = c("matched_via") if "matched_via" in members.columns else F.lit("exact_normalized")
    return members.select("cluster_id", F.row_number().over(Window.partitionBy("cluster_id").orderBy(priority(c("source")), "rec_id")).alias("rank"), "source", "source_id", "title_raw", "venue_raw", via.alias("matched_via"), F.when(via == "exact_normalized", 100).otherwise(90).alias("confidence"))


def review(clustered: DataFrame, orphans: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """What people should look at: orphans, clusters of one record, and close or blocked pairs."""
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("title_norm").alias("title_norm"), F.min("venue_norm").alias("venue_norm"), F.min("source").alias("source"))
    return {"orphans": orphans, "singletons": sizes.where("n = 1").drop("n"), "pairs": log.where("fate <> 'merged'")}
