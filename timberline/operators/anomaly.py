"""Rule, statistical and combined anomaly scores. The batch is the DataFrame given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberline import constants as K
from timberline.functions import text as T, timing as M
from timberline.operators.ordered import order_cells, with_index
from timberline.operators.skew import attach
from timberline.session import apart

_ROW = ["file", "line_number"]


def keyword_hits(entries: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Critical words in the message, their confidence and detail."""
    words = words or K.CRITICAL_KEYWORDS
    low, n = F.col("_low"), F.col("_n_hits")
    joined = F.col("_hits")
    return (
        entries.withColumn("_low", F.lower("message"))
        .withColumns({"_n_hits": T.count_words(low, words), "_hits": T.matched_words(low, words)})
        .withColumn("kw_hits", F.when(n > 0, F.split(joined, "\x1f")).otherwise(F.array().cast("array<string>")))
        .withColumn("kw_conf", F.when(n > 0, T.clamp(0.5 + 0.1 * n)))
        .withColumn("kw_detail", F.when(
            n > 0, F.concat(F.lit("Critical keywords found: "), F.replace(joined, F.lit("\x1f"), F.lit(", ")))))
        .drop("_low", "_n_hits", "_hits")
    )


def _spike_columns(df: DataFrame, count: Column, threshold: int) -> DataFrame:
    ratio = count / F.lit(float(threshold))
    hit = count >= threshold
    detail = F.concat(F.lit("Frequency spike: "), count.cast("string"),
                      F.lit(f" entries in window (threshold: {threshold})"))
    return (
        df.withColumn("spike_conf", F.when(hit, T.clamp(0.4 + 0.15 * (ratio - 1))))
        .withColumn("spike_detail", F.when(hit, detail))
    )


def frequency_spikes(entries: DataFrame, window_seconds: int = K.SPIKE_WINDOW_SECONDS,
                     threshold: int = K.SPIKE_THRESHOLD) -> DataFrame:
    """Rows in crowded tumbling windows that start at the first timestamp of the batch."""
    start = entries.agg(F.min("timestamp")).scalar()
    slot = F.floor(M.seconds_between(start, F.col("timestamp")) / window_seconds)
    slotted = entries.withColumn("spike_window", slot)
    counts = (slotted.filter("spike_window is not null").groupBy("spike_window")
              .agg(F.count("*").alias("spike_count")).filter(F.col("spike_count") >= threshold))
    return _spike_columns(attach(slotted, counts, ["spike_window"], "spike_count"),
                          F.col("spike_count"), threshold)


def sequential_spikes(entries: DataFrame, threshold: int = K.SPIKE_THRESHOLD) -> DataFrame:
    """Without any timestamp, every full block of ``threshold`` rows counts as a spike."""
    indexed = with_index(order_cells(entries, _ROW), _ROW, "position").drop("_cell")
    total = entries.agg(F.count("*")).scalar()
    slot = F.floor(F.col("position") / threshold)
    full = (slot + 1) * threshold <= total
    sized = (indexed.withColumn("spike_window", slot)
             .withColumn("spike_count", F.when(full, F.lit(threshold).cast("bigint"))).drop("position"))
    return _spike_columns(sized, F.col("spike_count"), threshold)


def repeated_errors(entries: DataFrame, min_repeats: int = 3, width: int | None = None) -> DataFrame:
    """ERROR and CRITICAL rows whose message recurs, or with ``width`` its first characters."""
    key = F.when(F.col("log_level").isin("ERROR", "CRITICAL"),
                 F.lower(T.strip(T.clip("message", width) if width else F.col("message"))))
    keyed = entries.withColumn("repeat_key", key)
    counts = (keyed.filter("repeat_key is not null").groupBy("repeat_key")
              .agg(F.count("*").alias("repeat_count")).filter(F.col("repeat_count") >= min_repeats))
    n = F.col("repeat_count")
    return (
        attach(keyed, counts, ["repeat_key"], "repeat_count").drop("repeat_key")
        .withColumn("repeat_conf", F.when(n.isNotNull(), T.clamp(0.3 + 0.1 * n)))
        .withColumn("repeat_detail", F.when(n.isNotNull(), F.concat(
            F.lit("Repeated error ("), n.cast("string"), F.lit(" occurrences)"))))
    )


def rule_engine(entries: DataFrame, window_seconds: int = K.SPIKE_WINDOW_SECONDS,
                threshold: int = K.SPIKE_THRESHOLD, timed: bool = True, tasks: int | None = None) -> DataFrame:
    """Best rule per row: rule_score, rule_type, rule_details; null type when none fires.

    ``timed=False`` is for batches without a single timestamp. ``tasks`` deals the rows over so many tasks before their texts
    are searched: after the joins Spark leaves as few as there are cores, which then grow with the batch.
    """
    spiked = (frequency_spikes(entries, window_seconds, threshold) if timed
              else sequential_spikes(entries, threshold))
    counted = repeated_errors(spiked)
    scored = keyword_hits(counted.repartition(tasks, *_ROW) if tasks else apart(counted))
    level = F.col("log_level")
    rules = [
        (F.col("kw_conf"), "critical_keyword", F.col("kw_detail")),
        (F.col("spike_conf"), "frequency_spike", F.col("spike_detail")),
        (F.col("repeat_conf"), "repeated_error", F.col("repeat_detail")),
        (F.when(level == "CRITICAL", F.lit(0.6)), "critical_level", F.lit("Log level is CRITICAL")),
        (F.when(level == "ERROR", F.lit(0.3)), "error_level", F.lit("Log level is ERROR")),
    ]
    # plain expressions over the five columns: arrays of structs would be interpreted row by row
    staged = scored.withColumns({f"_conf{i}": conf for i, (conf, _, _) in enumerate(rules)}).withColumn(
        "_best", F.greatest(*[f"_conf{i}" for i in range(len(rules))]))
    kind = F
    for i, (_, name, _) in enumerate(rules):
        kind = kind.when(F.col(f"_conf{i}") == F.col("_best"), name)
    told = [F.when(F.col(f"_conf{i}").isNotNull(), detail) for i, (_, _, detail) in enumerate(rules)]
    return (
        staged.withColumn("rule_score", F.coalesce("_best", F.lit(0.0)))
        .withColumn("rule_type", kind)
        .withColumn("rule_details", F.concat_ws("; ", *told))
        .select(*entries.columns, "rule_score", "rule_type", "rule_details")
    )


def with_features(entries: DataFrame) -> DataFrame:
    """Seven numbers describing an entry."""
    message = F.col("message")
    hits = T.count_words(F.col("_low"), K.FEATURE_KEYWORDS)

    def flag(name: str) -> Column:
        return F.when(T.blank_to_null(F.col(name)).isNotNull(), 1.0).otherwise(0.0)

    values = {
        "f_hour": F.coalesce(F.hour("timestamp") / F.lit(23.0), F.lit(0.5)),
        "f_level": F.coalesce(T.lookup(F.col("log_level"), K.FEATURE_LEVELS), F.lit(0.3)),
        "f_length": F.least(F.ln(1.0 + F.length(message)) / 10.0, F.lit(1.0)),
        "f_words": F.least(F.regexp_count(message, F.lit(r"\S+")) / 50.0, F.lit(1.0)),
        "f_keywords": F.least(hits / 5.0, F.lit(1.0)),
        "f_has_ip": flag("ip_address"),
        "f_has_code": flag("error_code"),
    }
    return entries.withColumn("_low", F.lower(message)).withColumns(values).drop("_low")


def zscore_outliers(featured: DataFrame, cutoff: float = 2.0,
                    batch: DataFrame | None = None) -> DataFrame:
    """stat_score from the largest absolute z-score over the features.

    ``batch`` holds the same rows with a shorter lineage, for the batch statistics.
    """
    source = featured if batch is None else batch
    stats = source.agg(F.struct(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in K.FEATURES],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in K.FEATURES],
    )).scalar()
    s = F.col("_stats")

    def z(f: str) -> Column:
        std = F.when(s[f"s_{f}"] < 1e-10, 1.0).otherwise(s[f"s_{f}"])
        return F.abs((F.col(f) - s[f"m_{f}"]) / std)

    score = T.clamp(1.0 - 1.0 / (1.0 + (F.col("max_z") - cutoff)))
    return (
        featured.withColumn("_stats", stats)
        .withColumn("max_z", F.greatest(*[z(f) for f in K.FEATURES]))
        .withColumn("stat_score", F.when((s["n"] < 3) | (F.col("max_z") < cutoff), 0.0).otherwise(score))
        .drop("_stats")
    )


def combine_scores(scored: DataFrame) -> DataFrame:
    """Final verdict from rule_score, ml_score and stat_score."""
    rule, ml, stat = F.col("rule_score"), F.col("ml_score"), F.col("stat_score")
    fired = F.col("rule_type").isNotNull()
    details = F.concat_ws(
        "; ",
        F.when(F.col("rule_details") != "", F.concat(F.lit("Rule: "), F.col("rule_details"))),
        F.when(ml > 0.3, F.format_string("ML score: %.2f", ml)),
        F.when(stat > 0.2, F.format_string("Z-score deviation: %.2f", stat)))
    kind = (
        F.when(fired & (rule >= F.greatest(ml, stat)), F.col("rule_type"))
        .when((ml >= stat) & (ml > 0.5), "ml_detected")
        .when(stat > 0.3, "statistical_outlier")
        .otherwise(F.coalesce("rule_type", F.lit("none"))))
    return (
        scored.withColumn("confidence", T.clamp(0.4 * rule + 0.3 * ml + 0.3 * stat))
        .withColumn("is_anomaly", fired | (ml > 0.7) | (stat > 0.5) | (F.col("confidence") > 0.45))
        .withColumn("anomaly_type", kind)
        .withColumn("details", details)
    )


def evaluate_anomalies(entries: DataFrame, window_seconds: int = K.SPIKE_WINDOW_SECONDS,
                       threshold: int = K.SPIKE_THRESHOLD, timed: bool = True,
                       forest: bool = False, tasks: int | None = None) -> DataFrame:
    """Entries with all three scores and the verdict; ``forest`` adds the ML score. ``tasks`` is that of ``rule_engine``."""
    from timberline.operators.forest import isolation_forest

    batch = with_features(entries)
    featured = apart(with_features(apart(rule_engine(entries, window_seconds, threshold, timed, tasks))))
    if forest:
        featured = isolation_forest(featured, batch=batch)
    else:
        featured = featured.withColumn("ml_score", F.lit(0.0))
    verdict = combine_scores(zscore_outliers(featured, batch=batch))
    return apart(verdict).select(
        *entries.columns, "is_anomaly", "confidence", "anomaly_type", "rule_score", "ml_score",
        "stat_score", "details")
