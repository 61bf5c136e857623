from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch, read
from gymlake.llm.url_rules import CONFIDENCE, MIN_BAD, MIN_SHARE, TOKENS, judge

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by five rules, and by what goes with blocked URLs and with labels of bad quality or toxicity of the same number."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return judge(read(spark, sf_dir, "pages"), RULES, labels, Scratch(spark))


_FITS = " ".join(f"when ('.' || host) like '%.{r[: r.index('/')]}' and starts_with(path, '{r[r.index('/') :]}') then '{v} {r}'" for v, r in sorted(RULES, key=lambda x: -len(x[1])))
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_transform(list_filter(regexp_split_to_array(regexp_replace({}, '[0-9]+', '0', 'g'), '{}'), lambda x: x <> ''), lambda x: '{}:' || x)"
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The SQL makes all sets of tokens that a URL has, so it takes the 12 rarest frequent ones, and none that more than this share of URLs have. The query has neither bound;
#: the results are the same where no URL has more than 12 and tokens that common are in all URLs, most of them good, as on the given tables.
COMMON = 0.9

OP11_SQL = f"""
with recursive
a as (select page_id, url, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end rest from pages),
b as (select page_id, url, regexp_extract(rest, '^[^/?#]*') host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) rest from a),
c as (select page_id, url, {_LOW.format("host")} host, regexp_extract(rest, '^[^?#]*') path, substr(rest, length(regexp_extract(rest, '^[^?#]*')) + 1) rest from b),
p as (
  select page_id, url, host, path, case {_FITS} end fit,
    list_sort(list_distinct({_WORDS.format("host", "[.]", "h")} || {_WORDS.format(_LOW.format("path"), _SPLIT, "p")} || {_WORDS.format(_LOW.format("rest"), _SPLIT, "q")})) tokens
  from c),
told as (select doc_id page_id, bool_or(coalesce(quality = 0, false) or coalesce(toxic = 1, false)) told from labels group by doc_id),
once as (
  select url, bad, min(tokens) tokens, row_number() over () id
  from (select url, tokens, coalesce(fit like 'block %', told) bad from p left join told using (page_id)) where bad is not null and len(tokens) > 0 group by url, bad),
least as (select count(*) n, greatest({MIN_BAD}, ceil(floor(count(*) * {MIN_SHARE} * 1000000) / 1000000)) least from once),
counts as (select token, count(*) n from (select unnest(tokens) token from once) group by token having count(*) >= (select least from least) and count(*) <= (select {COMMON} * n from least)),
it as (select id, bad, token from (select id, bad, token, row_number() over (partition by id order by n, token) place from (select id, bad, unnest(tokens) token from once) join counts using (token)) where place <= {TOKENS}),
s as (
  select id, bad, [token] items, token as last from it
  union all
  select s.id, s.bad, list_append(s.items, it.token), it.token from s join it on s.id = it.id and it.token > s.last
  qualify count(*) over (partition by list_append(s.items, it.token)) >= (select least from least)),
sure as (select items, count(*) filter (bad) / count(*) confidence from s group by items having count(*) filter (bad) >= (select least from least) and count(*) filter (bad) / count(*) >= {CONFIDENCE}),
rules as (select * from sure where not exists (select 1 from sure x where len(x.items) = len(sure.items) - 1 and list_has_all(sure.items, x.items) and x.confidence >= sure.confidence)),
found as (select tokens, max(confidence) confidence from (select distinct tokens from p where fit is null) join rules on list_has_all(tokens, items) group by tokens)
select page_id, host, path, split_part(fit, ' ', 2) rule, coalesce(split_part(fit, ' ', 1), case when confidence is null then 'allow' else 'block' end) verdict, confidence
from p left join found on p.fit is null and p.tokens = found.tokens"""

QUERIES = {"op11_url_filter": op11_url_filter}
ORACLES = {"op11_url_filter": OP11_SQL}
