"""Building training corpora: samples, merging, balancing, splitting, sampling, duplicates.

All random choices come from digests of the sample id, so they repeat on every run and retry.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.operators.ordered import (
    by_digest, by_value, number_rows, running_sums, seconds,
)
from codeloom.operators.similar_sets import in_cells, similar_pairs
from codeloom.session import cut_lineage


def order_hash(*parts: Column, seed: int = 42) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def shuffled(
    df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None, name: str = "rn", digits: int = 3
) -> DataFrame:
    """Adds the row's place in a reproducible shuffle, per ``by`` or over the whole table.

    The digest's first digits are buckets, so no task holds more than about 16^-digits of it.
    """
    h, bucket = by_digest(df.withColumn("_h", order_hash(F.col(key), seed=seed)), "_h", digits=digits)
    return number_rows(h, ["_h", key], bucket, by, name).drop("_h", "_bucket")


def split_by_position(
    samples: DataFrame, key: str = "sample_id", train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Adds split: floor(n * ratio) rows to train and val, the rest to test."""
    total = samples.agg(F.count(F.lit(1)).alias("_n"))
    s = shuffled(samples, key, seed, name="_rn").crossJoin(F.broadcast(total))  # one row of totals
    n_train, n_val = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    split = (
        F.when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_val, "val").otherwise("test")
    )
    return s.withColumn("split", split).drop("_rn", "_n")


def split_by_project(
    samples: DataFrame, project: str = "project", train: float = 0.6, val: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds split so that no project is in two splits: projects in digest order fill the shares."""
    sizes = samples.groupBy(project).agg(F.count(F.lit(1)).alias("_n"))
    h, bucket = by_digest(sizes.withColumn("_h", order_hash(F.col(project), seed=seed)), "_h")
    run = running_sums(h, ["_h", project], bucket, {"_upto": F.col("_n")})
    total = sizes.agg(F.sum("_n").alias("_all"))
    start = (F.col("_upto") - F.col("_n")) / F.col("_all")
    split = F.when(start < train, "train").when(start < train + val, "val").otherwise("test")
    of_project = run.crossJoin(F.broadcast(total)).select(F.col(project).alias("_project"), split.alias("split"))  # one row of totals
    # samples without a project are one project
    return samples.join(of_project, F.col(project).eqNullSafe(F.col("_project"))).drop("_project")


def split_by_time(
    samples: DataFrame, time: str = "ts", key: str = "sample_id", train: float = 0.6, val: float = 0.2,
    limits: list[float] | None = None,
) -> DataFrame:
    """Adds split: earlier samples train, later ones test, by percent rank of the time, then the key."""
    s = samples.withColumn("_t", seconds(samples, time))
    b, bucket = by_value(s, "_t", "_bucket", limits, key)
    total = samples.agg(F.count(F.lit(1)).alias("_all"))
    r = number_rows(b, ["_t", key], bucket, None, "_rn").crossJoin(F.broadcast(total))  # one row of totals
    place = (F.col("_rn") - 1) / F.greatest(F.col("_all") - 1, F.lit(1))
    split = F.when(place < train, "train").when(place < train + val, "val").otherwise("test")
    return r.withColumn("split", split).drop("_t", "_bucket", "_rn", "_all")


def balanced(
    samples: DataFrame, safe_ratio: float = 0.3, key: str = "sample_id", seed: int = 42
) -> DataFrame:
    """Originally safe rows are drawn, or repeated, to max(1, floor(r * others / (1 - r))).

    The target needs two counts, read by the plan itself; nothing is collected.  Adds ``copy``.
    """
    safe = samples.where(F.col("sample_type") == "originally_safe")
    other = samples.where(~F.col("sample_type").eqNullSafe("originally_safe"))
    counts = samples.agg(
        F.count_if(F.col("sample_type") == "originally_safe").alias("_safe"),
        F.count_if(~F.col("sample_type").eqNullSafe("originally_safe")).alias("_other"),
    )
    target = F.when(
        F.col("_other") > 0,
        F.greatest(F.lit(1), F.floor(F.lit(safe_ratio) * F.col("_other") / F.lit(1 - safe_ratio))),
    ).otherwise(F.col("_safe"))
    ranked = shuffled(safe, key, seed, name="_rn").crossJoin(F.broadcast(counts))  # one row of counts
    # row r stands at r, r + n, r + 2n, ...; it is repeated as often as such a place is within the target
    copies = F.floor((target - F.col("_rn") + F.col("_safe")) / F.col("_safe"))
    picked = ranked.where(copies >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    return other.withColumn("copy", F.lit(1).cast("bigint")).unionByName(picked.drop("_rn", "_safe", "_other"))


def balanced_per_group(
    samples: DataFrame, group: str, target: int, key: str = "sample_id", seed: int = 42, repeat: bool = True
) -> DataFrame:
    """Every group drawn down, or repeated up, to the target; adds ``copy``."""
    sizes = samples.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumnRenamed(group, "_group")
    r = shuffled(samples, key, seed, [group], "_rn").join(sizes, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    copies = F.floor((F.lit(target) - F.col("_rn") + F.col("_size")) / F.col("_size"))
    if not repeat:
        copies = F.least(copies, F.lit(1))
    return r.where(copies >= 1).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))
    ).drop("_rn", "_size")


def ratio_merge(
    samples: DataFrame, ratios: dict[str, float], origin: str = "origin", key: str = "sample_id", seed: int = 42
) -> DataFrame:
    """The largest mix in which the origins have the given shares, rows drawn by digest."""
    share = F.create_map(*[F.lit(x) for pair in ratios.items() for x in pair])[F.col(origin)]
    known = samples.where(F.col(origin).isin(*ratios))
    sizes = known.groupBy(origin).agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg(
        F.when(F.count(F.lit(1)) == len(ratios), F.min(F.col("_n") / share)).otherwise(0.0).alias("_whole")
    )
    r = shuffled(known, key, seed, [origin], "_rn").crossJoin(F.broadcast(whole))  # one row
    return r.where(F.col("_rn") <= F.floor(F.col("_whole") * share + F.lit(1e-9))).drop("_rn", "_whole")


def sampled_per_group(
    rows: DataFrame, group: str, per_group: int, limit: int | None = None, key: str = "sample_id", seed: int = 42
) -> DataFrame:
    """At most ``per_group`` rows per group by digest order, then at most ``limit`` rows in all.

    The per-group rank is cut per task before the shuffle, so a hot group sends few rows.
    """
    h = rows.withColumn("_h", order_hash(F.col(key), seed=seed))
    rn = F.row_number().over(W.partitionBy(group).orderBy("_h", key))
    kept = h.withColumn("_rn", rn).where(F.col("_rn") <= per_group)
    if limit is not None:
        kept = kept.orderBy("_h", key).limit(limit)
    return kept.drop("_h", "_rn")


def capped_collection(
    rows: DataFrame, group: str, query: str, per_query: int, per_group: int, order: list[str]
) -> DataFrame:
    """At most ``per_query`` rows per query and ``per_group`` per group, queries in their order."""
    q = F.row_number().over(W.partitionBy(group, query).orderBy(*order))
    first = rows.withColumn("_q", q).where(F.col("_q") <= per_query)
    g = F.row_number().over(W.partitionBy(group).orderBy(query, *order))
    return first.withColumn("_g", g).where(F.col("_g") <= per_group).drop("_q", "_g")


def merged_corpora(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both record sets; columns only one side has are null on the other."""
    return real.unionByName(synthetic, allowMissingColumns=True)


def merged_by_name(real: DataFrame, synthetic: DataFrame, name: str = "name") -> DataFrame:
    """Files of both sides; for the same name the synthetic one replaces the real one."""
    both = real.withColumn("_p", F.lit(0)).unionByName(synthetic.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (name, "_p")]
    best = both.groupBy(name).agg(F.max_by(F.struct(*rest), "_p").alias("_r"))
    return best.select(name, "_r.*")


def training_samples(records: DataFrame, safe_files: DataFrame) -> DataFrame:
    """Vulnerable, fixed and originally safe samples of one shape.

    ``records`` are version rows (one per before/after side), ``safe_files`` the safe corpus.
    """
    common = ["cve_id", "cwe_id", "vulnerability_type", "repo_url", "commit", "file_path", "code"]
    before = F.col("version") == "before"
    pairs = records.where(F.col("code").isNotNull()).select(
        *common, F.when(before, 1).otherwise(0).alias("label"),
        F.when(before, "vulnerable").otherwise("fixed").alias("sample_type"),
    )
    none = F.lit(None).cast("string")
    safe = safe_files.where(F.col("code").isNotNull()).select(
        none.alias("cve_id"), none.alias("cwe_id"), F.lit("none").alias("vulnerability_type"), "repo_url",
        F.coalesce("commit", F.lit("HEAD")).alias("commit"), "file_path", "code",
        F.lit(0).alias("label"), F.lit("originally_safe").alias("sample_type"),
    )
    return pairs.unionByName(safe)


def normalised_code(code: Column) -> Column:
    """Text for duplicate detection: blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(code, r"\s+", " ")))


def first_of_duplicates(rows: DataFrame, text: str, key: str) -> DataFrame:
    """digest, kept key and number of copies per normalised text; copies are counted before the shuffle."""
    d = F.sha2(F.encode(normalised_code(F.col(text)), "UTF-8"), 256)
    return rows.groupBy(d.alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def without_duplicates(rows: DataFrame, text: str, key: str) -> DataFrame:
    keep = first_of_duplicates(rows, text, key).select(key)
    return rows.join(keep, key, "left_semi")


def near_copies(rows: DataFrame, text: str, key: str, least: float = 0.8, words: int = 5, bands: int = 20, rows_per_band: int = 4) -> DataFrame:
    """(a, b, similarity): near copies whose word shingles have a Jaccard similarity of ``least`` or more.

    Texts with equal shingles are represented by the smallest key, which is paired with each other one at a similarity of 1.  Of two
    representatives every similar pair is returned.  Candidates share a band of the MinHash signature (at 0.8, all
    but one pair in 30,000 does); all texts of a band are compared shingle by shingle, hot bands in slices.
    """
    own = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def signatures(batches):
        r = np.random.default_rng(1)
        a, b = (r.integers(1, 1 << 61, bands * rows_per_band, dtype=np.uint64) | np.uint64(1) for _ in range(2))
        for batch in batches:
            out, whole, sizes = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t, words)
                low = [(h * x + y >> np.uint64(3)).min() for x, y in zip(a, b)]
                out.append([hash(tuple(int(v) for v in low[i : i + rows_per_band])) for i in range(0, len(low), rows_per_band)])
                whole.append(hashlib.sha256(h.tobytes()).hexdigest())
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                names=["key", "whole", "n", "bands"],
            )

    def digests(batches):
        for batch in batches:
            for t in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = [shingles(x, words).tobytes() for x in t.column(2).to_pylist()]
                same = pa.array([hashlib.sha256(x).hexdigest() == w for x, w in zip(sets, t.column(1).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(sets, pa.binary())], names=["node", "digests"]).filter(same)

    kind = own.schema["key"].dataType.simpleString()
    signed = cut_lineage(own.mapInArrow(signatures, f"key {kind}, whole string, n bigint, bands array<bigint>"), "signatures")
    first = cut_lineage(signed.groupBy("whole").agg(F.min(F.struct("key", "n", "bands")).alias("r")).select("whole", "r.*"), "first")
    banded = first.select(F.col("key").alias("node"), "n", F.posexplode("bands").alias("band", "value"))
    banded = banded.select("node", "n", F.xxhash64("band", "value").alias("bucket"))
    several = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket")
    members = cut_lineage(banded.join(several, "bucket"), "bands")
    wanted = members.select(F.col("node").alias("key")).distinct().join(first.select("key", "whole"), "key")
    sets = own.join(wanted, "key").select("key", "whole", "text").mapInArrow(digests, f"node {kind}, digests binary").dropDuplicates(["node"])
    pairs = similar_pairs(in_cells(members, sets), least, every=True)
    pairs = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "similarity").distinct()
    copies = signed.select("key", "whole").join(first.select(F.col("key").alias("a"), "whole"), "whole").where("a <> key").distinct()
    return pairs.unionByName(copies.select("a", F.col("key").alias("b"), F.lit(1.0).alias("similarity")))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit digests of the distinct word shingles; a shorter text is one shingle."""
    w = (text or "").lower().split()
    all_of = {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    return np.unique(np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in all_of], np.uint64))


def large_enough(nodes: DataFrame, minimum: int) -> DataFrame:
    """Graphs with at least ``minimum`` nodes."""
    return nodes.groupBy("file").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") >= minimum)


