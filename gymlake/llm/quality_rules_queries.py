from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gymlake.llm.common import read
from gymlake.llm.quality_rules import DELTA, RISK, RULES, STRATA, judge, settings


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_TESTS = "\n  union all ".join(
    f"select stratum, '{rule}' rule, {step} step, cast({cut} as double) cutoff, count(*) n, count(*) filter (where {rejects}) k from good group by stratum" for step, rule, cut, rejects in settings()
)
_BROKEN = "coalesce(" + ", ".join(f"case when {r} > c_{r} then '{r}' end" for r in RULES) + ")"

OP1_SQL = rf"""
with w as (
  select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
  from documents),
win as (select doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') g from w, unnest(generate_series(1, len(ws) - 7)) t(i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from win) where n > 1),
covered as (select doc_id, count(distinct i + k) n from twice, unnest(generate_series(0, 7)) t(k) group by doc_id),
f as (
  select w.doc_id, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(covered.n, 0) n_repeat_words
  from w left join covered using (doc_id)),
ready as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, {' + '.join(f'cast(n_words >= {n} as int)' for n in STRATA)} stratum,
    n_symbols / cast(greatest(n_words, 1) as double) symbols_per_word, n_dup_lines / cast(greatest(n_lines, 1) as double) dup_line_share,
    n_repeat_words / cast(greatest(n_words, 1) as double) repeat_share
  from f),
good as (select * from ready where not base_failed and doc_id in (select doc_id from labels group by doc_id having min(quality) = 1)),
tests as ({_TESTS}),
passed as (
  select *, k < {RISK} * n and (
      select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) from unnest(generate_series(0, k)) t(i)
    ) <= {DELTA / (len(STRATA) + 1)} as passes
  from tests),
held as (select *, bool_and(passes) over (partition by stratum order by step) held from passed),
chosen as (select stratum, rule, max_by(cutoff, step) cutoff from held where held group by stratum, rule),
wide as (select stratum, {', '.join(f"max(cutoff) filter (where rule = '{r}') c_{r}" for r in RULES)} from chosen group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_BROKEN} is null kept, {_BROKEN} "rule"
from ready left join wide using (stratum)"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": OP1_SQL}
