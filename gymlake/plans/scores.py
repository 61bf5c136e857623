"""Benchmark scores: per-domain means over judged samples and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.functions.stats import normalise_score
from gymlake.sources.tables import DIMENSIONS, JUDGED_SQL, judged


def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of valid dimensions on 0-100 by domain, and over all samples (domain TOTAL).

    0 marks an invalid score and is skipped; a dimension without any valid score is null.
    One partial aggregate answers both grouping sets.
    """
    rows = judged(spark, sf_dir)
    valid = F.coalesce(F.col("failed"), F.lit(1.0)) == 0.0
    means = [normalise_score(F.avg(F.when(valid & (F.col(d) != 0), F.col(d).cast("double")))).alias(d) for d in DIMENSIONS]
    return (
        rows.groupingSets([["domain"], []], "domain")
        .agg(F.grouping("domain").alias("is_total"), *means, F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_failed"))
        .select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("domain")).alias("domain"), *DIMENSIONS, "n_valid", "n_failed")
    )


DOMAIN_SCORES_SQL = f"""with {JUDGED_SQL}
select case when grouping(domain) = 1 then 'TOTAL' else domain end as domain,
  {', '.join(f"(avg(case when failed = 0 and {d} <> 0 then cast({d} as double) end) - 1) / 4 * 100 as {d}" for d in DIMENSIONS)},
  count(*) filter (where failed = 0) n_valid, count(*) filter (where failed <> 0) n_failed
from judged group by grouping sets ((domain), ())"""

QUERIES = {"domain_scores": domain_scores}
ORACLES = {"domain_scores": DOMAIN_SCORES_SQL}
