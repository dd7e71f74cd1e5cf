"""Root-cause groups: sessions of one template, cascades of groups, shared entities.

A group is named by its first row (``file:line``). Its members are a table of their
own, one row per member, so a group of any size never has to fit in one value.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from timberline import constants as K
from timberline.functions import text as T, timing as M
from timberline.operators.ordered import order_cells, with_carried, with_earlier_max, with_index, with_previous
from timberline.operators.settle import LEADS, OPEN, Event, settle
from timberline.operators.skew import attach
from timberline.operators.templates import with_template
from timberline.session import cut

_ORDER = ["template", "timestamp", "file", "line_number"]


def sessionize_templates(reports: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Members with ``event_id`` and ``place``: per template, a pause longer than the gap
    starts a new group; rows without a time form one more group per template.

    The scan is over range partitions of (template, time), so a template holding a third
    of the rows is spread over as many partitions.
    """
    keep = [c for c in ("template", "timestamp", "file", "line_number", "severity", "summary", "message", "source")
            if c in reports.columns or c == "template"]
    cells = order_cells(with_template(reports).select(*keep), _ORDER)
    steps = with_index(with_previous(cells, _ORDER, ["template", "timestamp"]), _ORDER)
    prev = F.col("prev")
    # nulls sort first: untimed rows of a template come together before its timed rows
    both_timed = prev["timestamp"].isNotNull() & F.col("timestamp").isNotNull()
    near = M.seconds_between(prev["timestamp"], F.col("timestamp")) <= gap_seconds
    untimed = prev["timestamp"].isNull() & F.col("timestamp").isNull()
    same = prev.isNotNull() & (prev["template"] == F.col("template")) & ((both_timed & near) | untimed)
    start = F.when(~F.coalesce(same, F.lit(False)), F.struct("file", "line_number", "index"))
    grouped = with_carried(steps, _ORDER, start, "start")
    name = F.concat(F.col("start.file"), F.lit(":"), F.col("start.line_number").cast("string"))
    return (grouped.withColumn("event_id", name)
            .withColumn("place", F.col("index") - F.col("start.index"))
            .drop("prev", "start", "index", "_cell"))


def with_sizes(members: DataFrame, min_size: int = 2) -> DataFrame:
    """Members of groups that are large enough, with the group size."""
    sizes = members.groupBy("event_id").agg(F.count("*").alias("event_count"))
    kept = sizes.filter(F.col("event_count") >= min_size)
    return attach(members, kept, ["event_id"], "event_count").filter("event_count is not null")


def severity_escalation(sized: DataFrame) -> DataFrame:
    """(event_id, escalated): the later half is clearly more severe than the earlier half."""
    rank = T.severity_rank("severity")
    timed = F.col("timestamp").isNotNull()
    early = F.col("place") < F.floor(F.col("event_count") / 2)
    halves = sized.groupBy("event_id").agg(
        F.avg(F.when(timed & early, rank)).alias("a"), F.avg(F.when(timed & ~early, rank)).alias("b"))
    return halves.select("event_id", F.coalesce(F.col("b") > F.col("a") + 0.5, F.lit(False)).alias("escalated"))


def root_causes(sized: DataFrame, total: Column) -> DataFrame:
    """One row per group: severity, confidence, title, description, time window."""
    rank = T.severity_rank("severity")
    timed = F.col("timestamp").isNotNull()
    early = F.col("place") < F.floor(F.col("event_count") / 2)
    summary = F.struct("place", "summary")
    # at most three summaries per group; apart, so that the other aggregates stay plain ones
    told = (sized.filter("place < 3").groupBy("event_id").agg(F.array_sort(F.collect_list(summary)).alias("s"))
            .withColumnRenamed("event_id", "_id"))
    groups = sized.groupBy("event_id").agg(
        F.first("template").alias("template_pattern"), F.first("event_count").alias("event_count"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.max(rank).alias("rank"),
        F.avg(F.when(timed & early, rank)).alias("a"), F.avg(F.when(timed & ~early, rank)).alias("b"),
        F.min(F.when(F.col("place") == 0, F.struct("file", "line_number"))).alias("first_row"))
    groups = groups.join(told, groups["event_id"] == told["_id"], "left")
    n = F.col("event_count")
    escalated = F.coalesce(F.col("b") > F.col("a") + 0.5, F.lit(False))
    density = F.least(n / F.greatest(total, F.lit(1)), F.lit(1.0))
    confidence = F.round(F.least(
        0.3 + density * 0.4 + F.when(escalated, 0.2).otherwise(0.0) + F.when(n >= 10, 0.1).otherwise(0.0),
        F.lit(1.0)), 3)
    short = F.when(F.length("template_pattern") > 80,
                   F.concat(T.clip("template_pattern", 80), F.lit("..."))).otherwise(F.col("template_pattern"))
    minutes = F.floor(M.seconds_between(F.col("start"), F.col("end")) / 60).cast("bigint")
    window = F.when(F.col("start").isNull(), F.format_string("Cluster of %d related events.", n)).otherwise(
        F.format_string(
            "Cluster of %d related events between %s and %s (~%d min window).", n,
            F.date_format("start", "HH:mm:ss"), F.date_format("end", "HH:mm:ss"), minutes))
    causes = F.array_distinct(F.filter(F.transform("s", lambda x: x["summary"]), lambda x: x != ""))
    likely = F.when(F.size(causes) > 0, F.concat(F.lit("Likely caused by: "), F.array_join(causes, "; ")))
    return (
        groups.withColumn("severity", T.severity_name(F.col("rank")))
        .select(
            "event_id",
            F.format_string("[%s] %s (%d occurrences)", F.col("severity"), short, n).alias("title"),
            F.concat_ws(" ", window, likely).alias("description"),
            "start", "end", confidence.alias("confidence"), "severity", "template_pattern", "event_count",
            F.col("first_row.file").alias("first_file"), F.col("first_row.line_number").alias("first_line"))
    )


def aggregate_root_causes(reports: DataFrame, gap_seconds: int = 300,
                          min_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of the reports given, usually the anomalies."""
    members = cut(with_sizes(sessionize_templates(reports, gap_seconds), min_size))
    total = reports.agg(F.count("*")).scalar()
    return root_causes(members, total), members


# --- correlation and cascades ----------------------------------------------------

_NEAR_SECONDS = 120   # fixed value: no temporal relation beyond this pause
_MIN_SCORE = 0.4      # fixed value: pairs at least this close belong together


def _reach(min_score: float) -> float:
    """Longest pause a pair can have and still score ``min_score``.

    Without the temporal part a pair scores at most 0.15 + 0.06, and scores are rounded
    to three digits.
    """
    temporal = (min_score - 0.0005 - 0.21) / 0.5
    if temporal <= 0:
        raise ValueError("min_score must exceed 0.21: lower scores do not depend on time")
    return _NEAR_SECONDS * (1.0 - temporal)


def pair_score(a: str, b: str) -> Column:
    """Score of an earlier event ``a`` and a later event ``b`` (alias prefixes)."""
    gap = M.seconds_between(F.least(f"{a}.end", f"{b}.end"), F.greatest(f"{a}.start", f"{b}.start"))
    temporal = (F.when(gap <= 0, 1.0).when(gap <= _NEAR_SECONDS, F.greatest(F.lit(0.0), 1.0 - gap / _NEAR_SECONDS))
                .otherwise(0.0))
    step = F.col(f"{b}.rank") - F.col(f"{a}.rank")
    escalation = F.when(step > 0, F.least(F.lit(0.5), step * 0.2)).otherwise(0.0)
    shared = F.size(F.array_intersect(f"{a}.words", f"{b}.words"))
    union = F.size(F.array_union(f"{a}.words", f"{b}.words"))
    similarity = F.when(union > 0, F.round(shared / union * 0.3, 3)).otherwise(0.0)
    return F.round(temporal * 0.5 + escalation * 0.3 + similarity * 0.2, 3)


def _prepared(events: DataFrame) -> DataFrame:
    """Timed events with their words and the key of the processing order."""
    return events.filter("start is not null").select(
        "event_id", "start", "end", T.severity_rank("severity").alias("rank"),
        F.array_distinct(F.filter(F.split(F.lower("template_pattern"), r"\s+"), lambda w: w != "")).alias("words"),
        F.struct((-F.col("confidence")).alias("c"), F.col("first_file").alias("f"),
                 F.col("first_line").alias("l")).alias("turn"))


def _cells(df: DataFrame, width: int, pad: float) -> DataFrame:
    """One row per time cell an event's padded window touches."""
    micros = int(pad * 1e6)
    low = F.floor((M.epoch_micros("start") - micros) / (width * 1_000_000))
    high = F.floor((M.epoch_micros("end") + micros) / (width * 1_000_000))
    return df.withColumn("cell", F.explode(F.sequence(low, high)))


def correlate_events(earlier: DataFrame, later: DataFrame, min_score: float = _MIN_SCORE,
                     width: int = 90) -> DataFrame:
    """Band join: scored pairs of an event and another one that comes after it in turn.

    Both sides are cut into time cells and met cell by cell; a pair is kept in the one
    cell where the later of the two padded windows begins.
    """
    return _correlated(_prepared(earlier), _prepared(later), min_score, width)


def _correlated(earlier: DataFrame, later: DataFrame, min_score: float, width: int) -> DataFrame:
    pad = _reach(min_score) / 2 + 0.001
    a = _cells(earlier, width, pad).alias("a")
    b = _cells(later, width, pad).alias("b")
    first_common = F.floor((M.epoch_micros(F.greatest("a.start", "b.start")) - int(pad * 1e6)) / (width * 1_000_000))
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.turn") < F.col("b.turn"))
                   & (first_common == F.col("a.cell")))
    return pairs.select(
        F.col("a.event_id").alias("leader_id"), F.col("b.event_id").alias("event_id"),
        F.col("a.turn").alias("leader_turn"), pair_score("a", "b").alias("score"),
    ).filter(F.col("score") >= min_score)


def cascade_leaders(events: DataFrame, min_score: float = _MIN_SCORE, width: int = 90,
                    block: int = 50_000) -> DataFrame:
    """Events that no earlier leader absorbs, taken in order of confidence.

    The time line is cut into islands: stretches whose events lie within each other's reach, found with a running maximum
    of the ends. Whole islands are put together to blocks of about ``block`` events, and a task settles a block by
    walking through its events once in order of confidence, so all islands are settled in one round however their
    events wait for each other. Islands beyond twice that are cut into blocks regardless and settled in rounds, see
    ``_settle_long``. Untimed events are near nothing and lead themselves.
    """
    order = ["start", "event_id"]
    rows = _prepared(events).select(
        "event_id", "start", "end", "rank", "words", "turn", M.epoch_micros("start").alias("start_us"),
        M.epoch_micros("end").alias("end_us"))
    scanned = with_earlier_max(with_index(order_cells(rows, order), order), order, "end_us", "_reached")
    opens = F.col("_reached").isNull() | (F.col("start_us") - F.col("_reached") > _reach_micros(min_score))
    islands = with_carried(scanned, order, F.when(opens, F.col("index")), "_island")
    placed = cut(islands.select(*rows.columns, F.floor(F.col("_island") / block).alias("block"), F.lit(False).alias("shared")))
    large = cut(placed.groupBy("block").agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * block))
    if large.isEmpty():
        led = _verdicts(placed, min_score).filter(F.col("verdict") == LEADS).select("event_id")
    else:
        told = cut(attach(placed, large, ["block"], "_n"))
        short = _verdicts(told.filter("_n is null"), min_score).filter(F.col("verdict") == LEADS).select("event_id")
        led = short.unionByName(_settle_long(told.filter("_n is not null").select(*rows.columns), min_score, width, block))
    return events.join(led, "event_id", "left_semi").unionByName(events.filter("start is null"))


def _reach_micros(min_score: float) -> int:
    return int(_reach(min_score) * 1e6) + 1000


def _verdicts(placed: DataFrame, min_score: float) -> DataFrame:
    """(event_id, verdict) of every row, settled block by block; a block fits in a task."""
    reach = _reach_micros(min_score)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["turn"]["c"], r["turn"]["f"], r["turn"]["l"]))
        found = settle([Event(r["event_id"], r["start_us"], r["end_us"], r["rank"], frozenset(r["words"]), r["shared"])
                        for r in rows], reach, min_score)
        return pa.table({"event_id": pa.array([r["event_id"] for r in rows], pa.string()),
                         "verdict": pa.array(found, pa.int32())})

    needed = ["block", "event_id", "start_us", "end_us", "rank", "words", "turn", "shared"]
    return placed.select(*needed).groupBy("block").applyInArrow(run, "event_id string, verdict int")


def _settle_long(rows: DataFrame, min_score: float, width: int, block: int, guests: int | None = None) -> DataFrame:
    """(event_id) of the leaders of islands that don't fit in a task.

    A round cuts the open events into blocks by their start; an event is also a guest of the later blocks it
    reaches. What a block settles holds where it depends on events of this block alone; an event leads if it leads in all its
    blocks. A block with more guests than ``guests`` (an eighth of a block, 8 at least) stops at the first of the others in
    turn: that one and all events after it, of home too, wait for a later round, since each may depend on it. What the new
    leaders absorb is taken out, and the rest goes on as long as it fills more than two blocks. No event is left out, and the
    first open event in turn is always settled, so this ends.
    """
    order, led = ["start", "event_id"], None
    guests = guests or max(8, block // 8)
    by_turn = Window.partitionBy("block").orderBy("turn")
    while rows.count() > 2 * block:
        cells = with_index(order_cells(rows, order), order)
        homes = cut(cells.withColumn("home", F.floor(F.col("index") / block)).drop("index", "_cell"))
        borders = homes.groupBy("home").agg(F.min("start_us").alias("at")).select(
            "at", F.lit(0).alias("kind"), F.lit("").alias("event_id"), "home")
        ends = homes.select((F.col("end_us") + _reach_micros(min_score)).alias("at"), F.lit(1).alias("kind"), "event_id",
                            F.lit(None).cast("bigint").alias("home"))
        key = ["at", "kind", "home", "event_id"]
        last = with_carried(order_cells(borders.unionByName(ends), key), key, F.col("home"), "last").filter("kind = 1")
        met = homes.join(last.select("event_id", "last"), "event_id")
        placed = (met.withColumn("shared", F.col("last") > F.col("home"))
                  .withColumn("block", F.explode(F.sequence("home", F.greatest("home", "last")))))
        visiting = placed.filter("block > home").withColumn("_place", F.row_number().over(by_turn))
        # one row per block at most
        stops = visiting.filter(F.col("_place") == guests + 1).select("block", F.col("turn").alias("_stop"))
        marked = placed.join(F.broadcast(stops), "block", "left")
        goes = F.col("_stop").isNull() | (F.col("turn") < F.col("_stop"))
        waiting = marked.filter(~goes).select("event_id", F.lit(OPEN).alias("verdict"))
        summed = (_verdicts(marked.filter(goes), min_score).unionByName(waiting).groupBy("event_id")
                  .agg(F.max("verdict").alias("verdict")))
        told = cut(rows.join(summed, "event_id"))
        won = told.filter(F.col("verdict") == LEADS).drop("verdict")
        rest = told.filter(F.col("verdict") == OPEN).drop("verdict")
        taken = _correlated(won, rest, min_score, width).select("event_id")
        rows = cut(rest.join(taken, "event_id", "left_anti"))
        led = won.select("event_id") if led is None else led.unionByName(won.select("event_id"))
    at_last = rows.withColumn("block", F.lit(0)).withColumn("shared", F.lit(False))
    remaining = _verdicts(at_last, min_score).filter(F.col("verdict") == LEADS).select("event_id")
    return remaining if led is None else led.unionByName(remaining)


def cascade_map(events: DataFrame, leaders: DataFrame, min_score: float = _MIN_SCORE,
                width: int = 90) -> DataFrame:
    """(event_id, leader_id): every event with the first leader that absorbs it, or itself."""
    owned = (correlate_events(leaders, events, min_score, width).groupBy("event_id")
             .agg(F.min_by("leader_id", "leader_turn").alias("leader_id")))
    free = leaders.select("event_id", F.col("event_id").alias("leader_id"))
    return owned.join(leaders, "event_id", "left_anti").unionByName(free)


def detect_cascades(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Merge the groups of a leader into one event."""
    rank = T.severity_rank("severity")
    best = F.struct(-F.col("confidence"), "first_file", "first_line")
    # the leader is the most confident member, so it is the primary
    merged = events.join(mapping, "event_id").groupBy("leader_id").agg(
        F.count("*").alias("groups"), F.sum("event_count").alias("total"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.max(rank).alias("rank"),
        F.min_by(F.struct("title", "description", "confidence", "template_pattern", "first_file", "first_line"),
                 best).alias("p"))
    p, many = F.col("p"), F.col("groups") > 1
    return merged.select(
        F.col("leader_id").alias("event_id"),
        F.when(many, F.concat(F.lit("[CASCADE] "), p["title"])).otherwise(p["title"]).alias("title"),
        F.when(many, F.format_string(
            "Cascade of %d related incident groups (%d total events). %s", F.col("groups"), F.col("total"),
            p["description"])).otherwise(p["description"]).alias("description"),
        "start", "end",
        F.when(many, F.least(p["confidence"] + 0.1, F.lit(1.0))).otherwise(p["confidence"]).alias("confidence"),
        T.severity_name(F.col("rank")).alias("severity"), p["template_pattern"].alias("template_pattern"),
        F.col("total").alias("event_count"), p["first_file"].alias("first_file"),
        p["first_line"].alias("first_line"), "groups")


# --- entities and actions ------------------------------------------------------------

def event_entities(members: DataFrame) -> DataFrame:
    """(event_id, kind, value, n): IPs, code tokens and sources of each group."""
    message = F.col("message")
    tokens = F.regexp_extract_all(message, F.lit(K.ERROR_TOKEN), F.lit(0))
    numbers = F.regexp_extract_all(message, F.lit(K.NUMERIC_CODE), F.lit(0))

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = members.select(
        "event_id", "timestamp", "file", "line_number",
        F.explode(F.concat(
            tagged("ip", T.all_ips(message)), tagged("code", tokens), tagged("number", numbers),
            tagged("source", F.array(T.blank_to_null(F.col("source")))))).alias("e"))
    return found.filter("e.value is not null").groupBy("event_id", "e.kind", "e.value").agg(
        F.count("*").alias("n"), F.min(F.struct("timestamp", "file", "line_number")).alias("seen"))


def entity_rollup(members: DataFrame) -> DataFrame:
    """Per group: number of IPs and code tokens, first three tokens, dominant source.

    Bare numbers count as codes only in groups that hold a real code token. The counts
    are of rows already reduced to one per group and value.
    """
    entities = event_entities(members)
    kinds = entities.groupBy("event_id").agg(
        F.count_if(F.col("kind") == "ip").alias("n_ips"),
        F.count_if(F.col("kind") == "code").alias("n_tokens"),
        F.min_by(F.when(F.col("kind") == "source", F.col("value")),
                 F.when(F.col("kind") == "source", F.struct(-F.col("n"), "seen"))).alias("dominant_source"))
    with_tokens = kinds.filter("n_tokens > 0").select("event_id")
    codes = (entities.filter(F.col("kind").isin("code", "number"))
             .join(with_tokens, "event_id", "left_semi")
             .select("event_id", "value").distinct())
    order = Window.partitionBy("event_id").orderBy("value")
    first = (codes.withColumn("p", F.row_number().over(order)).filter("p <= 3")
             .groupBy("event_id").agg(F.array_sort(F.collect_list("value")).alias("codes")))
    count = codes.groupBy("event_id").agg(F.count("*").alias("n_codes"))
    return (
        kinds.join(count, "event_id", "left").join(first, "event_id", "left")
        .select("event_id", "n_ips", F.coalesce("n_codes", F.lit(0)).alias("n_codes"),
                F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), "dominant_source")
    )


def recommended_actions(template: Column, n_ips: Column, codes: Column, n_codes: Column,
                        source: Column) -> Column:
    """Up to five remediation steps for what was observed."""
    low = F.lower(template)
    steps = []
    for words, actions in K.ACTION_RULES:
        steps += [F.when(T.contains_any(low, words), F.lit(a)) for a in actions]
    dots = F.when(n_codes > 3, "...").otherwise("")
    steps += [
        F.when(source.isNotNull(), F.concat(F.lit("Prioritize investigation of service/module: "), source, F.lit("."))),
        F.when(n_ips > 0, F.format_string(
            "Observed %d distinct IP(s); review access logs and rate-limit if necessary.", n_ips)),
        F.when(n_codes > 0, F.concat(F.lit("Error tokens observed: "), F.array_join(codes, ", "), dots, F.lit("."))),
    ]
    found = F.array_distinct(F.array_compact(F.array(*steps)))
    return F.when(F.size(found) > 0, F.slice(found, 1, 5)).otherwise(T.lit_array(K.ACTION_FALLBACK))


def enrich(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events with entities, actions and a summary naming them, most confident first."""
    rolled = events.join(entity_rollup(members), "event_id", "left").withColumns({
        "n_ips": F.coalesce("n_ips", F.lit(0)), "n_codes": F.coalesce("n_codes", F.lit(0)),
        "codes": F.coalesce("codes", F.array().cast("array<string>"))})
    bits = F.concat_ws(
        ", ",
        F.when(F.col("n_ips") > 0, F.format_string("%d distinct IP(s)", F.col("n_ips"))),
        F.when(F.col("n_codes") > 0, F.format_string("%d error token(s)", F.col("n_codes"))),
        F.when(F.col("dominant_source").isNotNull(), F.concat(F.lit("source="), "dominant_source")))
    suffix = F.when(bits != "", F.concat(F.lit(" Observed entities: "), bits, F.lit("."))).otherwise("")
    actions = recommended_actions(
        F.col("template_pattern"), F.col("n_ips"), F.col("codes"), F.col("n_codes"), F.col("dominant_source"))
    return (rolled.withColumn("summary", F.concat("description", suffix))
            .withColumn("recommended_action", actions)
            .orderBy(F.col("confidence").desc(), "first_file", "first_line"))


def build_root_causes(reports: DataFrame, gap_seconds: int = 300,
                      min_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """(root causes, members): groups, cascades, entities and actions."""
    groups, members = aggregate_root_causes(reports, gap_seconds, min_size)
    groups = cut(groups)
    mapping = cut(cascade_map(groups, cascade_leaders(groups)))
    # the mapping has one row per group and a group may be hot, so members keep their spread
    sizes = groups.select("event_id", "event_count").join(mapping, "event_id")
    moved = (attach(members.drop("event_count"), sizes, ["event_id"], "event_count")
             .drop("event_id", "event_count").withColumnRenamed("leader_id", "event_id"))
    return enrich(detect_cascades(groups, mapping), moved), moved
