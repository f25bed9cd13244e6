"""Questions about tenants, projects, scans, findings, jobs and audit logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.ordered import by_value, number_rows, quantile_limits, seconds

DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
SEVERITIES = ["critical", "high", "medium", "low"]


def only(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the wanted values; values that are None do not restrict."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def newest(rows: DataFrame, time: str = "created_at", n: int | None = None, tie: str = "id", **wanted) -> DataFrame:
    """Newest first for the wanted tenant, project, status or actor."""
    out = only(rows, **wanted).orderBy(F.desc(time), tie)
    return out if n is None else out.limit(n)


def page_bounds(page: int | None, size: int | None) -> tuple[int, int]:
    page = 1 if page is None or page < 1 else page
    size = DEFAULT_PAGE_SIZE if size is None or size < 1 else min(size, MAX_PAGE_SIZE)
    return page, size


def page_of(rows: DataFrame, page: int | None, size: int | None, time: str, tie: str) -> DataFrame:
    """One page, newest first, with the true total and the number of pages on every row.

    Rows are counted per stretch of time; only the stretches that hold the page are read again and numbered, in buckets, so
    that a moment with most rows is not sorted by one task.
    """
    page, size = page_bounds(page, size)
    first, last = (page - 1) * size + 1, page * size
    age = F.coalesce(-seconds(rows, time), F.lit(float("inf")))  # rows without a time come last
    aged = rows.withColumn("_age", age)
    limits = quantile_limits(aged, "_age")
    placed, bucket = by_value(aged, "_age", limits=limits)
    counts = sorted(tuple(r) for r in placed.groupBy(bucket).agg(F.count(F.lit(1))).collect())  # a row per bucket
    held, before, total = [], 0, 0
    for place, n in counts:
        if total < last and total + n >= first:
            before = before if held else total
            held.append(place)
        total += n
    found = placed.where(F.col(bucket).isin(held)).drop(bucket)
    part, bucket = by_value(found, "_age", tie=tie)
    n = number_rows(part, [F.desc(time), F.col(tie)], bucket, None, "_rn")
    cut = n.where((F.col("_rn") + before).between(first, last)).drop("_age", bucket, "_rn")
    pages = F.lit(-(-total // size)).cast("bigint")
    return cut.select(
        *rows.columns, F.lit(page).alias("page"), F.lit(size).alias("page_size"), F.lit(total).cast("bigint").alias("total"), pages.alias("total_pages")
    )


def subject_allowed(subject: Column, patterns: Column) -> Column:
    """The subject matches one of the patterns from its start; * stands for anything; none = allow."""
    none = F.coalesce(F.size(patterns), F.lit(0)) <= 0
    hit = F.exists(patterns, lambda p: F.rlike(subject, F.concat(F.lit("^(?:"), F.replace(p, F.lit("*"), F.lit(".*")), F.lit(")"))))
    return F.coalesce(none | hit, F.lit(False))


def projects_for_subjects(subjects: DataFrame, projects: DataFrame) -> DataFrame:
    """Each OIDC subject with its project and whether the project allows it."""
    repo = X.subject_repo(F.col("subject"))
    s = subjects.withColumn("_r", repo).select(
        "*", F.col("_r.org").alias("github_org"), F.col("_r.repo").alias("github_repo")
    ).drop("_r")
    first = projects.groupBy("github_org", "github_repo").agg(
        F.min_by(F.struct("project_id", "tenant_id", "allowed_subject_patterns"), "project_id").alias("p")
    )
    j = s.join(first, ["github_org", "github_repo"], "left")
    status = (
        F.when(F.col("github_org").isNull(), "invalid subject").when(F.col("p").isNull(), "unknown project")
        .when(subject_allowed(F.col("subject"), F.col("p.allowed_subject_patterns")), "allowed").otherwise("denied")
    )
    return j.select("subject", "p.project_id", "p.tenant_id", status.alias("status"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """One row: total, open, fixed and open-or-not counts per severity."""
    return findings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "fixed").alias("fixed"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    )


def dashboard(projects: DataFrame, scans: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """One row of dashboard numbers, with findings per OWASP category as a map."""
    day = F.expr("INTERVAL 1 DAY")
    p = projects.agg(F.count(F.lit(1)).alias("projects"), F.count_if("active").alias("active_projects"))
    s = scans.agg(
        F.count(F.lit(1)).alias("scans"),
        F.count_if(F.col("created_at") > now - day * 7).alias("scans_this_week"),
        F.count_if(F.col("created_at") > now - day * 30).alias("scans_this_month"),
    )
    by = findings.groupBy("owasp_category").agg(F.count(F.lit(1)).alias("n"))
    owasp = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("owasp_category", "n")))).alias("by_owasp"))
    f = finding_counts(findings).withColumnsRenamed(
        {"total": "findings", "open": "open_findings", "fixed": "fixed_findings"}
    )
    return p.crossJoin(s).crossJoin(f).crossJoin(owasp)  # one row each; ten OWASP categories


def daily_trend(scans: DataFrame, findings: DataFrame, first: Column, last: Column) -> DataFrame:
    """date, scans, findings, fixed for every day of the range, days without events included."""
    def per_day(df, time, scan, found, done):
        return df.where(F.col(time).isNotNull()).select(
            F.to_date(time).alias("date"), F.lit(scan).alias("s"), F.lit(found).alias("f"), F.lit(done).alias("x")
        )

    events = per_day(scans, "created_at", 1, 0, 0).unionByName(per_day(findings, "created_at", 0, 1, 0)).unionByName(
        per_day(findings, "fixed_at", 0, 0, 1)
    )
    counts = events.groupBy("date").agg(F.sum("s").alias("s"), F.sum("f").alias("f"), F.sum("x").alias("x"))
    spark = scans.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    zero = F.lit(0).cast("bigint")
    return days.join(counts, "date", "left").select(
        "date", F.coalesce("s", zero).alias("scans"), F.coalesce("f", zero).alias("findings"),
        F.coalesce("x", zero).alias("fixed"),
    )


def project_stats(projects: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans, findings, open, fixed and the last scan per project; projects without any included."""
    s = scans.groupBy("project_id").agg(F.count(F.lit(1)).alias("s"), F.max("created_at").alias("last_scan_at"))
    f = findings.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("f"), F.count_if(F.col("status") == "open").alias("o"),
        F.count_if(F.col("status") == "fixed").alias("x"),
    )
    zero = F.lit(0).cast("bigint")
    return projects.select("project_id").join(s, "project_id", "left").join(f, "project_id", "left").select(
        "project_id", F.coalesce("s", zero).alias("total_scans"), F.coalesce("f", zero).alias("total_findings"),
        F.coalesce("o", zero).alias("open_findings"), F.coalesce("x", zero).alias("fixed_findings"), "last_scan_at",
    )


def scan_severities(findings: DataFrame) -> DataFrame:
    """Findings per severity and scan, one column per severity."""
    p = findings.groupBy("scan_id").pivot("severity", SEVERITIES).agg(F.count(F.lit(1)))
    return p.fillna(0).withColumnsRenamed({s: f"{s}_count" for s in SEVERITIES})


def duration_ms(started: Column, finished: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", started, finished)


def expiry(created: Column, days: int) -> Column:
    return created + F.make_dt_interval(F.lit(days))


def unexpired(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    return rows.where(F.col(expires) > now)


def audit_id(ts: Column, actor: Column) -> Column:
    """Milliseconds of the event and the start of the actor's digest."""
    return F.concat_ws("-", F.unix_millis(ts.cast("timestamp")).cast("string"), F.left(F.md5(actor), F.lit(8)))


