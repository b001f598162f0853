"""Job and stage logs, ledgers and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.plans.registry import query


def _avg(c: str):
    return F.avg(F.col(c).cast("decimal(18,6)")).cast("double")


@query("a7_job_log", "jobs", "SELECT job_id, count(*) AS n_stages, count(DISTINCT stage) AS n_kinds, round(sum(cast(sec AS decimal(18, 6)))::double, 4) AS total_sec, count(*) FILTER (WHERE status = 'error') AS n_errors FROM jobs GROUP BY job_id")
def job_log(jobs: DataFrame) -> DataFrame:
    """Totals of each job's stages."""
    return jobs.groupBy("job_id").agg(F.count("*").alias("n_stages"), F.count_distinct("stage").alias("n_kinds"), F.round(F.sum(F.col("sec").cast("decimal(18,6)")).cast("double"), 4).alias("total_sec"), F.count_if(F.col("status") == "error").alias("n_errors"))


@query("a14_expiring_cache", "jobs", """WITH f AS (SELECT stage || '/' || job_id AS key, sec AS value, ts AS fetched_at, event_id FROM jobs), n AS (SELECT max(ts) AS now FROM jobs), u AS (SELECT * FROM f, n WHERE fetched_at > now - INTERVAL 7 DAY)
    SELECT key, arg_max(value, (fetched_at, event_id)) AS value, max(fetched_at) AS fetched_at FROM u GROUP BY key""")  # fmt: skip
def expiring_cache(jobs: DataFrame) -> DataFrame:
    """Cached answers younger than 7 days, the newest of each key."""
    now = jobs.agg(F.max("ts").alias("now"))
    rows = jobs.select(F.concat_ws("/", "stage", "job_id").alias("key"), F.col("sec").alias("value"), F.col("ts").alias("fetched_at"), "event_id")
    fresh = rows.join(F.broadcast(now), F.col("fetched_at") > F.col("now") - F.expr("INTERVAL 7 DAYS"))  # one row
    return fresh.groupBy("key").agg(F.max_by("value", F.struct("fetched_at", "event_id")).alias("value"), F.max("fetched_at").alias("fetched_at"))


@query("a15_speed_ratio", "jobs", "SELECT job_id, round(7018.0 / greatest(sum(cast(sec AS decimal(18, 6)))::double, 0.1), 4) AS speed FROM jobs GROUP BY job_id")
def speed_ratio(jobs: DataFrame, duration: float = 7018.0) -> DataFrame:
    """A recording's length over its total stage seconds, .1 at least."""
    total = F.sum(F.col("sec").cast("decimal(18,6)")).cast("double")
    return jobs.groupBy("job_id").agg(F.round(duration / F.greatest(total, F.lit(0.1)), 4).alias("speed"))


@query("b26_escalate_after_match", "jobs", "SELECT event_id, CASE WHEN status = 'ok' THEN 'no: matched' WHEN sec < 30 THEN 'yes: low resolution' WHEN stage <> 'view' THEN 'yes: font' ELSE 'no' END AS decision FROM jobs")
def escalate_after_match(jobs: DataFrame) -> DataFrame:
    """Matched no, low resolution yes, font not standard yes, else no (status, seconds and stage stand for these)."""
    decision = F.when(F.col("status") == "ok", "no: matched").when(F.col("sec") < 30, "yes: low resolution").when(F.col("stage") != "view", "yes: font").otherwise("no")
    return jobs.select("event_id", decision.alias("decision"))


@query("c21_stage_status", "jobs", "SELECT job_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'fallback') THEN 'fallback' WHEN bool_or(status = 'ok') THEN 'ok' ELSE 'skipped' END AS status FROM jobs GROUP BY job_id")
def stage_status(jobs: DataFrame) -> DataFrame:
    """The worst status of a job: error, fallback, ok, or all skipped."""
    rank = F.max(F.when(F.col("status") == "error", 3).when(F.col("status") == "fallback", 2).when(F.col("status") == "ok", 1).otherwise(0))
    return jobs.groupBy("job_id").agg(F.element_at(F.array(*map(F.lit, ("skipped", "ok", "fallback", "error"))), rank + 1).alias("status"))


@query("c23_batch_summary", "jobs", "SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'error') AS success, count(*) FILTER (WHERE status = 'error') AS failed, round(sum(cast(sec AS decimal(18, 6)))::double, 4) AS total_sec, round(avg(cast(sec AS decimal(18, 6)))::double, 4) AS mean_sec FROM jobs")
def batch_summary(jobs: DataFrame) -> DataFrame:
    """Runs, successes, failures and times of all jobs."""
    bad = F.col("status") == "error"
    return jobs.agg(F.count("*").alias("total"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed"), F.round(F.sum(F.col("sec").cast("decimal(18,6)")).cast("double"), 4).alias("total_sec"), F.round(_avg("sec"), 4).alias("mean_sec"))


@query("c24_profile_summary", "jobs", "WITH l AS (SELECT job_id, stage, arg_max(sec, (ts, event_id)) AS last_sec, max(sec) AS max_sec FROM jobs GROUP BY ALL) SELECT stage, count(*) AS jobs, round(avg(cast(last_sec AS decimal(18, 6)))::double, 4) AS mean_last, max(max_sec) AS max_sec FROM l GROUP BY stage")
def profile_summary(jobs: DataFrame) -> DataFrame:
    """The last event of each job's stage, averaged a stage, and the longest."""
    last = jobs.groupBy("job_id", "stage").agg(F.max_by("sec", F.struct("ts", "event_id")).alias("last_sec"), F.max("sec").alias("max_sec"))
    return last.groupBy("stage").agg(F.count("*").alias("jobs"), F.round(_avg("last_sec"), 4).alias("mean_last"), F.max("max_sec").alias("max_sec"))


@query("c25_monthly_quota", "jobs", """WITH u AS (SELECT date_trunc('month', ts)::timestamp AS month, event_id, sec / 60 AS minutes, sum(cast(sec AS decimal(18, 6))) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::double / 60 AS used FROM jobs)
    SELECT month, event_id, round(used, 4) AS used, round(greatest(1000.0 - used, 0.0), 4) AS remaining, 1000.0 - used + minutes >= minutes AS enough FROM u""")  # fmt: skip
def monthly_quota(jobs: DataFrame, limit: float = 1000.0) -> DataFrame:
    """Minutes used and left of a month after each request, and whether the request still fitted. Running sums are taken
    within a day and added to the sums of the month's days before it, so no task orders a whole month."""
    rows = jobs.select("event_id", "ts", "sec", F.date_trunc("month", "ts").alias("month"), F.to_date("ts").alias("day"), F.col("sec").cast("decimal(18,6)").alias("exact"))
    days = rows.groupBy("month", "day").agg(F.sum("exact").alias("total"))
    earlier = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.coalesce(F.sum("total").over(earlier), F.lit(0).cast("decimal(38,6)")).alias("before"))
    within = Window.partitionBy("day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("exact").over(within)).join(before, "day").withColumn("used", (F.col("before") + F.col("within")).cast("double") / 60)
    minutes = F.col("sec") / 60
    return rows.select(F.col("month").cast("timestamp_ntz").alias("month"), "event_id", F.round("used", 4).alias("used"), F.round(F.greatest(limit - F.col("used"), F.lit(0.0)), 4).alias("remaining"), (limit - F.col("used") + minutes >= minutes).alias("enough"))


@query("c31_stage_times", "jobs", "SELECT stage, status, count(*) AS n, round(avg(cast(sec AS decimal(18, 6)))::double, 4) AS mean_sec, round(quantile_cont(sec, 0.5), 6) AS median_sec, round(quantile_cont(sec, 0.95), 6) AS p95_sec FROM jobs GROUP BY ALL")
def stage_times(jobs: DataFrame) -> DataFrame:
    """Run times by stage and status. Equal times are counted first, so percentiles stand on distinct times."""
    times = jobs.groupBy("stage", "status", "sec").agg(F.count("*").alias("times"), F.sum(F.col("sec").cast("decimal(18,6)")).alias("total"))
    share = lambda q: F.round(F.percentile("sec", q, F.col("times")), 6)
    mean = F.round(F.sum("total").cast("double") / F.sum("times"), 4)
    return times.groupBy("stage", "status").agg(F.sum("times").alias("n"), mean.alias("mean_sec"), share(0.5).alias("median_sec"), share(0.95).alias("p95_sec"))


#: Least confidence that ends the search, and the seconds from which a late sample exists.
SURE, LATE_FROM = 0.75, 510
_TRIALS = {"mix": (1, 2), "c0": (3, 4), "c1": (5, 6)}


def _sql_vote(n: str) -> str:
    return f"""CASE WHEN {n}_l2 IS NULL OR {n}_l1 = {n}_l2 OR {n}_p1 > {n}_p2 THEN {n}_l1 ELSE {n}_l2 END AS {n}_lang,
      CASE WHEN {n}_l2 IS NULL THEN {n}_p1 WHEN {n}_l1 = {n}_l2 THEN ({n}_p1 + {n}_p2) / 2 ELSE greatest({n}_p1, {n}_p2) END AS {n}_p"""


@query(
    "e15_language_rounds", "language_samples",
    f"""WITH a AS (SELECT job_id, any_value(channels) AS channels, any_value(seconds) AS seconds, {', '.join(f"max(CASE WHEN sample = {r} THEN lang END) AS {n}_l{i}, max(CASE WHEN sample = {r} THEN p END) AS {n}_p{i}" for n, rs in _TRIALS.items() for i, r in enumerate(rs, 1))},
      {', '.join(f"max(CASE WHEN sample = {r} THEN lang END) AS l_{n}, max(CASE WHEN sample = {r} THEN p END) AS p_{n}" for n, r in (("mix", 7), ("c0", 8), ("c1", 9)))} FROM language_samples GROUP BY job_id),
    v AS (SELECT *, {', '.join(_sql_vote(n) for n in _TRIALS)} FROM a),
    t AS (SELECT *, mix_p < {SURE} AND channels >= 2 AS again FROM v), c AS (SELECT *, again AND coalesce(c0_p > mix_p, false) AS by0 FROM t),
    d AS (SELECT *, again AND coalesce(c1_p > CASE WHEN by0 THEN c0_p ELSE mix_p END, false) AS by1 FROM c),
    b AS (SELECT *, CASE WHEN by1 THEN 'c1' WHEN by0 THEN 'c0' ELSE 'mix' END AS source, CASE WHEN by1 THEN c1_lang WHEN by0 THEN c0_lang ELSE mix_lang END AS lang, CASE WHEN by1 THEN c1_p WHEN by0 THEN c0_p ELSE mix_p END AS p,
          CASE WHEN by1 THEN l_c1 WHEN by0 THEN l_c0 ELSE l_mix END AS late_lang, CASE WHEN by1 THEN p_c1 WHEN by0 THEN p_c0 ELSE p_mix END AS late_p FROM d),
    f AS (SELECT *, p < {SURE} AND seconds >= {LATE_FROM} AND coalesce(late_p > p, false) AS late FROM b)
    SELECT job_id, CASE WHEN late THEN late_lang ELSE lang END AS lang, round(CASE WHEN late THEN late_p ELSE p END, 6) AS p, source, late FROM f""",
)
def language_rounds(samples: DataFrame) -> DataFrame:
    """E15 with its later rounds: below .75 the two channels of a stereo recording vote as the mix did, each taken if it is
    surer than what stands; below .75 still, a recording of 510 seconds or more has a late sample of the source that leads,
    taken if it is surer. samples (job_id, sample, lang, p, channels, seconds) has one row a sample: 1-2 of the mix, 3-4 and
    5-6 of the channels, 7-9 the late ones in this order. One aggregate a recording holds all that the rounds ask for."""
    at = lambda c, n: F.max(F.when(F.col("sample") == n, F.col(c)))
    cells = [at(c, r).alias(f"{n}_{c}{i}") for n, rs in _TRIALS.items() for i, r in enumerate(rs, 1) for c in ("lang", "p")]
    late = [at(c, r).alias(f"late_{n}_{c}") for n, r in zip(_TRIALS, (7, 8, 9), strict=True) for c in ("lang", "p")]
    rows = samples.groupBy("job_id").agg(F.any_value("channels").alias("channels"), F.any_value("seconds").alias("seconds"), *cells, *late)

    def vote(n: str):
        l1, l2, p1, p2 = (F.col(f"{n}_{c}") for c in ("lang1", "lang2", "p1", "p2"))
        lang = F.when(l2.isNull() | (l1 == l2) | (p1 > p2), l1).otherwise(l2)
        return F.struct(lang.alias("lang"), F.when(l2.isNull(), p1).when(l1 == l2, (p1 + p2) / 2).otherwise(F.greatest(p1, p2)).alias("p"), F.lit(n).alias("source"))

    surer = lambda new, old, able: F.when(able & F.coalesce(new["p"] > old["p"], F.lit(False)), new).otherwise(old)
    rows = rows.withColumn("mix", vote("mix")).withColumn("c0", vote("c0")).withColumn("c1", vote("c1"))
    again = (F.col("mix.p") < SURE) & (F.col("channels") >= 2)
    rows = rows.withColumn("best", surer(F.col("c0"), F.col("mix"), again)).withColumn("best", surer(F.col("c1"), F.col("best"), again))
    for c in ("lang", "p"):
        rows = rows.withColumn(f"late_{c}", F.when(F.col("best.source") == "mix", F.col(f"late_mix_{c}")).when(F.col("best.source") == "c0", F.col(f"late_c0_{c}")).otherwise(F.col(f"late_c1_{c}")))
    late_wins = (F.col("best.p") < SURE) & (F.col("seconds") >= LATE_FROM) & F.coalesce(F.col("late_p") > F.col("best.p"), F.lit(False))
    rows = rows.withColumn("late", late_wins)
    return rows.select("job_id", F.when(F.col("late"), F.col("late_lang")).otherwise(F.col("best.lang")).alias("lang"), F.round(F.when(F.col("late"), F.col("late_p")).otherwise(F.col("best.p")), 6).alias("p"), "best.source", "late")


@query("e15_language_vote", "jobs", """WITH s AS (SELECT job_id, event_id, stage AS lang, least(sec / 100, 1.0) AS p, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS r FROM jobs), a AS (SELECT job_id, max(CASE WHEN r = 1 THEN lang END) AS l1, max(CASE WHEN r = 1 THEN p END) AS p1, max(CASE WHEN r = 2 THEN lang END) AS l2, max(CASE WHEN r = 2 THEN p END) AS p2 FROM s WHERE r <= 2 GROUP BY job_id)
    SELECT job_id, CASE WHEN l2 IS NULL OR l1 = l2 OR p1 > p2 THEN l1 ELSE l2 END AS lang, round(CASE WHEN l2 IS NULL THEN p1 WHEN l1 = l2 THEN (p1 + p2) / 2 ELSE greatest(p1, p2) END, 6) AS p, CASE WHEN l2 IS NULL THEN p1 WHEN l1 = l2 THEN (p1 + p2) / 2 ELSE greatest(p1, p2) END < 0.75 AS retry FROM a""")  # fmt: skip
def language_vote(jobs: DataFrame) -> DataFrame:
    """Two samples of a job: agreement has their mean, conflict the higher one (the second on ties); below .75 it is tried again."""
    r = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    rows = jobs.select("job_id", F.col("stage").alias("lang"), F.least(F.col("sec") / 100, F.lit(1.0)).alias("p"), r.alias("r")).where("r <= 2")
    pick = lambda c, n: F.max(F.when(F.col("r") == n, F.col(c))).alias(f"{c[0]}{n}")
    both = rows.groupBy("job_id").agg(pick("lang", 1), pick("p", 1), pick("lang", 2), pick("p", 2))
    p = F.when(F.col("l2").isNull(), F.col("p1")).when(F.col("l1") == F.col("l2"), (F.col("p1") + F.col("p2")) / 2).otherwise(F.greatest("p1", "p2"))
    lang = F.when(F.col("l2").isNull() | (F.col("l1") == F.col("l2")) | (F.col("p1") > F.col("p2")), F.col("l1")).otherwise(F.col("l2"))
    return both.select("job_id", lang.alias("lang"), F.round(p, 6).alias("p"), (p < 0.75).alias("retry"))


@query("h2_ledger_batch", "jobs", "WITH d AS (SELECT job_id, max(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS code, max(ts) AS finished_at FROM jobs GROUP BY job_id) SELECT job_id, code AS returncode, finished_at FROM d WHERE code = 0")
def ledger(jobs: DataFrame) -> DataFrame:
    """H2, batch twin: jobs that have completed, which a resumed run skips."""
    done = jobs.groupBy("job_id").agg(F.max(F.when(F.col("status") == "error", 1).otherwise(0)).alias("returncode"), F.max("ts").alias("finished_at"))
    return done.where("returncode = 0")


@query("h3_requeue", "jobs", "WITH l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM jobs GROUP BY job_id), q AS (SELECT job_id, CASE WHEN status IN ('ok', 'error') THEN 'pending' WHEN status = 'fallback' THEN 'running' ELSE status END AS status, ts FROM l) SELECT job_id, status, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY status ORDER BY ts, job_id) END AS position FROM q")
def requeue(jobs: DataFrame) -> DataFrame:
    """H3, batch twin: finished and failed jobs are pending again, running ones stay; places in the queue by age."""
    last = jobs.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
    state = F.when(F.col("status").isin("ok", "error"), "pending").when(F.col("status") == "fallback", "running").otherwise(F.col("status"))
    rows = last.withColumn("status", state)
    rows = rows.withColumn("day", F.to_date("ts"))
    counts = rows.where("status = 'pending'").groupBy("day").agg(F.count("*").alias("n"))
    before = counts.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))  # one row a day
    place = F.row_number().over(Window.partitionBy("status", "day").orderBy("ts", "job_id")) + F.col("before")
    return rows.join(before, "day", "left").select("job_id", "status", F.when(F.col("status") == "pending", place).alias("position"))


@query("h5_stage_statistics", "jobs", "SELECT stage, count(*) AS n, round(sum(cast(sec AS decimal(18, 6)))::double, 4) AS total_sec, max(sec) AS max_sec FROM jobs GROUP BY stage")
def stage_statistics(jobs: DataFrame) -> DataFrame:
    """H5, batch twin of the running statistics."""
    return jobs.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum(F.col("sec").cast("decimal(18,6)")).cast("double"), 4).alias("total_sec"), F.max("sec").alias("max_sec"))


@query("h6_quota_by_month", "jobs", "SELECT date_trunc('month', ts)::timestamp AS month, round(sum(cast(sec AS decimal(18, 6)))::double / 60, 4) AS minutes FROM jobs GROUP BY ALL")
def quota_by_month(jobs: DataFrame) -> DataFrame:
    """H6, batch twin of the monthly quota."""
    return jobs.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum(F.col("sec").cast("decimal(18,6)")).cast("double") / 60, 4).alias("minutes"))
