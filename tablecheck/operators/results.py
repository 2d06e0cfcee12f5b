"""Analytics over stored runs and check results.

``runs``     run_id, source_id, dag_id, run_at, total, passed, failed, status
``results``  run_id, check_no, check_id, check_name, passed (0/1), value_actual, expected, message
``stored``   run_id, check_no, check_id, name, passed (0/1), value, expected, run_at
``sources``  id, name, type, alert_enabled
``checks``   id, source_id, name, query, assert_type, assert_value, tags, is_active

Listings order by time, newest first; ties are broken by all key columns so that pages are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Check names that a listing page shows.
ANOMALY_NAMES = "anomal|zscore|volume|trend|distribution"
CROSS_TABLE_NAMES = "cross|referential|integrity"
DISTRIBUTION_NAMES = "distrib"

# Tags that a detector puts in front of its message.
ANOMALY_TAGS = r"\[(zscore|ewma|holt_winters)\]"

# What detectors write after their tag.
TREND_TEXT, SCORE_TEXT = r"trend=(\w+)", r"(?:z|norm_score)=([0-9.]+)"

_KEY = ("run_id", "check_no", "check_id")


def _since(column: str, as_of: str, days: int) -> Column:
    return F.col(column) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def score(passed: str = "passed", total: str = "total") -> str:
    return f"round(try_divide({passed} * 100.0D, nullif({total}, 0)), 1)"


LIGHT = "CASE WHEN score IS NULL THEN 'grey' WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS light"


# -- scores ------------------------------------------------------------------------------------


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each source; of runs at the same time the one with the greater id.

    Numeric ids are packed with the time into one decimal: with buffers of fixed width Spark aggregates by hash in each
    task, so a source with most of the runs is one row there and nothing is sorted. Text ids are compared as texts.
    """
    packed = "CAST(unix_micros(CAST(run_at AS TIMESTAMP)) AS DECIMAL(18, 0)) * 10000000000000000000BD + CAST(run_id AS DECIMAL(19, 0))"
    numeric = isinstance(runs.schema["run_id"].dataType, T.IntegralType)
    order = F.expr(packed if numeric else "struct(CAST(run_at AS TIMESTAMP), run_id)")
    ordered = runs.select("source_id", "run_id", "total", "passed", "run_at", order.alias("k"))
    return ordered.groupBy("source_id").agg(*[F.max_by(c, "k").alias(c) for c in ("run_id", "total", "passed", "run_at")])


def health_scores(runs: DataFrame) -> DataFrame:
    return latest_runs(runs).selectExpr("source_id", "passed", "total", "run_at", f"{score()} AS score").selectExpr("*", LIGHT)


def all_scores(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source with the score of its newest run; grey without one."""
    newest = latest_runs(runs)
    return sources.join(newest, sources["id"] == newest["source_id"], "left").selectExpr(
        "id AS source_id", "name AS source_name", f"{score()} AS score", "run_at"
    ).selectExpr("*", LIGHT)


def score_trend(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Daily score of each source over the last days."""
    recent = runs.where(_since("run_at", as_of, days))
    return recent.groupBy("source_id", F.to_date("run_at").alias("day")).agg(
        F.expr(f"{score('sum(passed)', 'sum(total)')} AS score")
    )


# -- dashboard ---------------------------------------------------------------------------------


def dashboard_totals(runs: DataFrame, as_of: str) -> DataFrame:
    """Runs, success rate in percent, and the checks and failures of the day ``as_of``."""
    today = F.to_date("run_at") == F.lit(as_of[:10]).cast("date")
    return runs.agg(
        F.count("*").alias("total_runs"),
        F.expr("coalesce(round(try_divide(sum(passed) * 100.0D, sum(total)), 0), 0.0D) AS success_rate"),
        F.coalesce(F.sum(F.when(today, F.col("total"))), F.lit(0)).alias("today_checks"),
        F.coalesce(F.sum(F.when(today, F.col("failed"))), F.lit(0)).alias("failed_checks"),
    )


def dashboard_trend(runs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return runs.where(_since("run_at", as_of, days)).groupBy(F.to_date("run_at").alias("day")).agg(
        F.sum("passed").alias("passed"), F.sum("failed").alias("failed")
    ).orderBy("day")


def source_rates(runs: DataFrame, sources: DataFrame, unnamed: str = "unknown") -> DataFrame:
    """Success rate per source, worst first; runs are summed before they meet the sources."""
    sums = runs.groupBy("source_id").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    named = sums.join(sources.select("id", "name"), F.col("source_id") == F.col("id"), "left")
    rate = F.expr("coalesce(round(try_divide(sum(passed) * 100.0D, nullif(sum(total), 0)), 0), 0.0D) AS success_rate")
    return named.groupBy("id", "name").agg(rate).select(
        F.coalesce("name", F.lit(unnamed)).alias("source_name"), "success_rate"
    ).orderBy("success_rate", "source_name")


def top_failures(results: DataFrame, limit: int = 10) -> DataFrame:
    counts = results.groupBy("check_name").agg(
        F.count("*").alias("total_count"), F.count_if(F.col("passed") == 0).alias("fail_count")
    )
    return (
        counts.where("fail_count > 0")
        .withColumn("fail_pct", F.expr("round(fail_count * 100.0D / total_count, 0)"))
        .orderBy(F.desc("fail_count"), "check_name")
        .limit(limit)
    )


def overview(sources: DataFrame, checks: DataFrame, runs: DataFrame) -> DataFrame:
    """Three counts, each from its own one-row aggregation."""
    def rows(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    return sources.sparkSession.sql("SELECT 1").select(
        rows(sources).alias("source_count"), rows(checks.where("is_active = 1")).alias("check_count"),
        rows(runs).alias("run_count"),
    )


# -- listings ----------------------------------------------------------------------------------


def results_with_runs(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results next to their run; a run with very many results is split by adaptive execution."""
    return results.join(runs.select("run_id", "source_id", "dag_id", "run_at"), "run_id")


def list_results(results: DataFrame, runs: DataFrame, passed: bool | None = None, limit: int | None = 500, offset: int = 0) -> DataFrame:
    chosen = results if passed is None else results.where(F.col("passed") == int(passed))
    ordered = results_with_runs(chosen, runs).orderBy(F.desc("run_at"), *_KEY)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def matching_results(
    results: DataFrame, runs: DataFrame, names: str, source_id: int | None = None, limit: int | None = 200
) -> DataFrame:
    """Results whose check name has one of the given parts, in any case."""
    chosen = results.where(F.col("check_name").rlike(f"(?i){names}"))
    if source_id is not None:
        runs = runs.where(F.col("source_id") == source_id)
    listed = results_with_runs(chosen, runs).select(
        *_KEY, "check_name", "passed", "value_actual", "expected", "message", "run_at", "source_id"
    )
    return listed if limit is None else listed.orderBy(F.desc("run_at"), *_KEY).limit(limit)


def bi_results(
    stored: DataFrame, runs: DataFrame, name: str | None = None, passed: bool | None = None,
    dag_id: str | None = None, limit: int | None = 500, offset: int = 0,
) -> DataFrame:
    """Stored results with their run's pipeline, also those whose run is gone.

    Results carry their own time. Unless the pipeline is filtered, the page is cut before the
    join, which then only looks up the runs of that page.
    """
    chosen = stored
    if name is not None:
        chosen = chosen.where(F.col("name") == name)
    if passed is not None:
        chosen = chosen.where(F.col("passed") == int(passed))
    header = runs.select("run_id", "dag_id")

    def page(df: DataFrame) -> DataFrame:
        ordered = df.orderBy(F.desc("run_at"), *_KEY, "value", "passed")
        ordered = ordered.offset(offset) if offset else ordered
        return ordered if limit is None else ordered.limit(limit)

    if dag_id is not None:
        return page(chosen.join(header.where(F.col("dag_id") == dag_id), "run_id"))
    return page(chosen).join(header, "run_id", "left").orderBy(F.desc("run_at"), *_KEY)


def by_family(results: DataFrame) -> DataFrame:
    """Results per family: the first two words of the check name."""
    return results.groupBy(F.substring_index("check_name", "_", 2).alias("family")).agg(F.count("*").alias("n"))


def parse_messages(results: DataFrame) -> DataFrame:
    """Method, trend and score that detectors wrote into their messages."""
    message = F.coalesce("message", F.lit(""))

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))

    return results.withColumn("method", found(ANOMALY_TAGS)).withColumn(
        "trend", F.coalesce(found(TREND_TEXT), F.lit("stable"))
    ).withColumn("score", found(SCORE_TEXT).try_cast("double"))


def _two(text: str, mean: str | None = None, std: str | None = None) -> tuple[str, str]:
    """Mean and deviation out of ``a,b``, a single number, or ``mean=.. std=..``."""
    first = f"try_cast(split({text}, ',')[0] AS DOUBLE)"
    second = f"try_cast(get(split({text}, ','), 1) AS DOUBLE)"
    if mean is None:
        return first, second
    named = f"{text} RLIKE '{mean}'"
    return (
        f"if({named}, try_cast(regexp_extract({text}, '{mean}', 1) AS DOUBLE), {first})",
        f"if({named}, try_cast(regexp_extract({text}, '{std}', 1) AS DOUBLE), {second})",
    )


def parse_distributions(listed: DataFrame) -> DataFrame:
    actual = _two("value_actual")
    expected = _two("expected", "mean=([0-9.]+)", "std=([0-9.]+)")
    return listed.selectExpr(
        "*", f"{actual[0]} AS actual_mean", f"{actual[1]} AS actual_std",
        f"{expected[0]} AS expected_mean", f"{expected[1]} AS expected_std",
    )


def newest_first_reversed(listed: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` results, oldest of them first."""
    newest = listed.orderBy(F.desc("run_at"), *_KEY).limit(n)
    return newest.orderBy("run_at", *[F.desc(k) for k in _KEY])


def pass_fail(listed: DataFrame) -> DataFrame:
    return listed.agg(F.count_if(F.col("passed") == 1).alias("passed"), F.count_if(F.col("passed") == 0).alias("failed"))


# -- runs --------------------------------------------------------------------------------------


def recent_runs(runs: DataFrame, sources: DataFrame, limit: int | None = 100, dag_id: str | None = None) -> DataFrame:
    """The newest runs with their source's name, looked up after the cut."""
    chosen = runs if dag_id is None else runs.where(F.col("dag_id") == dag_id)
    newest = chosen if limit is None else chosen.orderBy(F.desc("run_at"), "run_id").limit(limit)
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return newest.join(names, "source_id", "left").orderBy(F.desc("run_at"), "run_id")


def run_details(results: DataFrame, runs: DataFrame, sources: DataFrame, run_id: int | None = None) -> DataFrame:
    """Each result under its run's header, labelled; of one run or of all."""
    if run_id is not None:
        results, runs = results.where(F.col("run_id") == run_id), runs.where(F.col("run_id") == run_id)
    tagged = F.coalesce(F.col("message"), F.lit("")).rlike(ANOMALY_TAGS)
    label = (
        F.when(tagged & (F.col("passed") == 1), "PASS (anomaly)").when(tagged, "ANOMALY")
        .when(F.col("passed") == 1, "PASS").otherwise("FAIL")
    )
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    header = runs.select("run_id", "source_id", "run_at", "status").join(names, "source_id", "left")
    return results.join(header, "run_id").select(
        "run_id", "source_name", "run_at", "status", "check_no", "check_id", "check_name", label.alias("label")
    )


# -- registry ----------------------------------------------------------------------------------


def sources_with_checks(sources: DataFrame, checks: DataFrame) -> DataFrame:
    """Every source with its number of active checks, 0 included."""
    active = checks.where("is_active = 1").groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(active, sources["id"] == active["source_id"], "left").select(
        "id", "name", F.coalesce("n", F.lit(0)).alias("check_count")
    )


def list_checks(checks: DataFrame, sources: DataFrame, source_id: int | None = None) -> DataFrame:
    chosen = checks if source_id is None else checks.where(F.col("source_id") == source_id)
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return chosen.join(names, "source_id").orderBy("source_name", "id")


def rules_of_sources(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """Active checks with what their source is, as a suite reads them; tags split into a list."""
    typed = sources.select(F.col("id").alias("source_id"), F.col("type").alias("source_type"))
    active = checks.where("is_active = 1").join(typed, "source_id")
    return active.select(
        "source_id", "source_type", F.col("id").alias("check_id"), "name", "query", "assert_type", "assert_value",
        F.filter(F.split("tags", ","), lambda t: t != "").alias("tags"),
    )


# -- digests -----------------------------------------------------------------------------------


def alert_digest(results: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """The alert of each failed run as lines: part 0 the header, 1 anomalies, 2 failed rules.

    ``run_id, part, check_no, check_id, anomalies, rules, line``. Lines stay rows, so the size of
    a run does not matter; reading them by ``run_id, part, check_no, check_id`` gives the text.
    Sources without the switch are alerted, switched-off ones are not; runs without failures
    have no digest.
    """
    failed = results.where("passed = 0").withColumn(
        "anomaly", F.coalesce(F.col("message"), F.lit("")).rlike(ANOMALY_TAGS)
    )
    switch = sources.select(F.col("id").alias("source_id"), "alert_enabled")
    alerted = runs.join(switch, "source_id", "left").where("coalesce(alert_enabled, 1) = 1").select("run_id", "dag_id")
    counts = failed.groupBy("run_id").agg(
        F.count_if("anomaly").alias("anomalies"), F.count_if(~F.col("anomaly")).alias("rules")
    )
    headers = counts.join(alerted, "run_id").selectExpr(
        "run_id", "0 AS part", "CAST(NULL AS INT) AS check_no", "CAST(NULL AS BIGINT) AS check_id", "anomalies", "rules",
        "concat('run #', coalesce(CAST(run_id AS STRING), '?'), ', source: ', coalesce(dag_id, ''), ', failed: ', anomalies + rules, ' checks') AS line",
    )
    lines = failed.join(alerted.select("run_id"), "run_id", "left_semi").selectExpr(
        "run_id", "if(anomaly, 1, 2) AS part", "check_no", "check_id", "CAST(NULL AS BIGINT) AS anomalies",
        "CAST(NULL AS BIGINT) AS rules",
        "concat(coalesce(check_name, '?'), if(anomaly, concat(': ', coalesce(message, '?')), concat(': value ', coalesce(CAST(value_actual AS STRING), '?'), ', expected ', coalesce(expected, '?')))) AS line",
    )
    return headers.unionByName(lines)


def period_summary(runs: DataFrame, period: str) -> DataFrame:
    """Totals per source and day, week or month."""
    sums = runs.groupBy("source_id", F.date_trunc(period, "run_at").alias("start")).agg(
        F.sum("total").alias("total"), F.sum("passed").alias("passed")
    )
    return sums.selectExpr(
        "source_id", f"'{period}' AS period", "start", "total", "passed", "total - passed AS failed",
        "coalesce(round(try_divide(passed * 100.0D, nullif(total, 0)), 1), 0.0D) AS pct",
    )
