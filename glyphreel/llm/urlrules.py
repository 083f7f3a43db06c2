"""URL filter: given host/path rules first, mined association rules for the rest. DataFrame operations only.

Urls under a given rule are the labelled ones; Spark's FP-growth mines combinations of their tokens that occur together
with a verdict. A token fills one of eight slots (top and registered domain, first label, first two path segments, depth,
ending, set of query keys), so no url, however long, has more than 255 combinations, and none is left out. Rules are kept
by support, confidence and lift over the verdict's share, and a rule is pruned where a more general one of the same
verdict is at least as confident.
An inverted index from a rule's rarest token to the rule finds, by join, the rules that a url can satisfy; the url takes
the verdict with the highest confidence (then support, then `block`), or the label majority if no rule fits.

Cases: a null url or one without :// has empty host and path and no tokens, so it takes the default verdict; repeated
urls are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphreel.llm.common import checkpointed, table

#: (rule, verdict): host and path prefix; the longest rule that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
#: Confidence over the share of the verdict among the labelled urls.
MIN_LIFT = 1.05


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))


def given(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda i: reduce(lambda c, r: c.when(fits(r[0]), F.lit(r[i])), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    return pick(0), pick(1)


def url_tokens() -> Column:
    """At most eight tokens of the row's url, one for each slot, in order: a row has at most 255 combinations."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    n, depth = F.size(labels), F.size(segments)
    named = lambda i: F.regexp_replace(F.lower(F.get(segments, F.lit(i))), "[0-9]+", "0")
    end = F.when(F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1))).when(F.endswith("path", F.lit("/")), "/").otherwise("-")
    keys = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"[?&]([A-Za-z0-9_]+)="), F.lit(1)))), ",")
    slots = [
        F.when(n >= 1, F.concat(F.lit("top:"), F.element_at(labels, -1))),
        F.when(n >= 2, F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -2, 2), "."))),
        F.when(n >= 3, F.concat(F.lit("sub:"), F.get(labels, F.lit(0)))),
        F.when(depth >= 1, F.concat(F.lit("first:"), named(0))),
        F.when(depth >= 2, F.concat(F.lit("second:"), named(1))),
        F.concat(F.lit("depth:"), depth.cast("string")),
        F.concat(F.lit("end:"), end),
        F.when(keys != "", F.concat(F.lit("keys:"), keys)),
    ]
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(F.array(*slots))))


def parsed(pages: DataFrame, rules: tuple[tuple[str, str], ...], key: str = "page_id") -> DataFrame:
    host, path = host_path(F.col("url"))
    rule, verdict = given(rules)
    return pages.select(key, "url").withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("ruled", verdict)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support of the kept rules; labelled has tokens and ruled."""
    items = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict:"), "ruled")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).freqItemsets
    sets = checkpointed(labelled.sparkSession, sets)
    sets = sets.withColumn("class", F.filter("items", lambda x: F.startswith(x, F.lit("verdict:")))).withColumn("tokens", F.array_sort(F.array_except("items", "class")))
    whole = sets.where((F.size("class") == 0) & (F.size("tokens") > 0)).select("tokens", F.col("freq").alias("all"))
    found = sets.where((F.size("class") == 1) & (F.size("tokens") > 0)).select("tokens", F.substring(F.element_at("class", 1), 9, 99).alias("verdict"), "freq")
    prior = labelled.groupBy(F.col("ruled").alias("verdict")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).select("verdict", "share")
    rules = found.join(whole, "tokens").withColumn("confidence", F.col("freq") / F.col("all")).where(F.col("confidence") >= min_confidence)
    rules = rules.join(prior, "verdict").where(F.col("confidence") >= min_lift * F.col("share"))
    rules = rules.withColumn("rule_id", F.concat_ws(" ", "tokens")).select("rule_id", "tokens", "verdict", "confidence", F.col("freq").alias("support"))
    # a rule goes if dropping one of its tokens leaves a rule of the same verdict that is as confident
    shorter = rules.where(F.size("tokens") > 1).select("rule_id", "verdict", "confidence", F.explode("tokens").alias("t"), "tokens").select("rule_id", "verdict", "confidence", F.concat_ws(" ", F.array_remove("tokens", F.col("t"))).alias("general"))
    beaten = shorter.alias("s").join(rules.alias("g"), (F.col("s.general") == F.col("g.rule_id")) & (F.col("s.verdict") == F.col("g.verdict")) & (F.col("g.confidence") >= F.col("s.confidence"))).select(F.col("s.rule_id").alias("rule_id"), F.col("s.verdict").alias("verdict")).distinct()
    return rules.join(beaten, ["rule_id", "verdict"], "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, and the mined rule with its confidence, for every row."""
    rows = parsed(pages, rules, key).withColumn("tokens", url_tokens())
    labelled = rows.where(F.col("ruled").isNotNull() & (F.size("tokens") > 0))
    mined = checkpointed(pages.sparkSession, mine(labelled))
    # the inverted index: each rule stands under its least frequent token alone, so a common token lists few rules
    often = mined.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    slots = mined.select("rule_id", "verdict", F.explode("tokens").alias("t")).join(often, "t").groupBy("rule_id", "verdict").agg(F.min_by("t", F.struct("n", "t")).alias("t"))
    index = mined.join(slots, ["rule_id", "verdict"]).groupBy("t").agg(F.collect_list(F.struct("confidence", "support", "verdict", "rule_id", "tokens")).alias("under"))
    # urls of equal tokens are judged once
    kinds = rows.where(F.col("ruled").isNull()).select("tokens").distinct()
    looked = kinds.select("tokens", F.explode("tokens").alias("t")).join(index, "t")
    fit = looked.select("tokens", F.filter("under", lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0).alias("fit")).where(F.size("fit") > 0)
    best = fit.select("tokens", F.array_max("fit").alias("b")).groupBy("tokens").agg(F.max(F.struct("b.confidence", "b.support", "b.verdict", "b.rule_id")).alias("b"))
    major = labelled.groupBy("ruled").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("ruled", F.struct("n", "ruled")).alias("major"))
    out = rows.join(best, "tokens", "left").join(F.broadcast(major), how="left")
    verdict = F.coalesce("ruled", "b.verdict", "major", F.lit("allow"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("b.rule_id")).alias("mined_rule"), F.when(F.col("ruled").isNull(), F.col("b.confidence")).alias("confidence"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""with r as (select page_id, url, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, url, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path from r),
g as (select *, '.' || host as dotted from h),
f as (select *, case when ends_with(dotted, '.example.com') and starts_with(path, '/de/') then 'example.com/de/' when ends_with(dotted, '.example.net') and starts_with(path, '/en/') then 'example.net/en/' when ends_with(dotted, '.org') and starts_with(path, '/fr/') then 'org/fr/' when ends_with(dotted, '.net') and starts_with(path, '/') then 'net/' end as rule from g),
s as (select *, list_filter(string_split(host, '.'), lambda x: x <> '') as labels, list_filter(string_split(path, '/'), lambda x: x <> '') as segs, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(url, ''), '[?&]([A-Za-z0-9_]+)=', 1))), ',') as keys, case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' end as ruled from f),
k as (select page_id, host, path, rule, ruled, case when host = '' then [] else list_sort(list_filter([
case when len(labels) >= 1 then 'top:' || labels[-1] end, case when len(labels) >= 2 then 'domain:' || labels[-2] || '.' || labels[-1] end, case when len(labels) >= 3 then 'sub:' || labels[1] end,
case when len(segs) >= 1 then 'first:' || regexp_replace(lower(segs[1]), '[0-9]+', '0', 'g') end, case when len(segs) >= 2 then 'second:' || regexp_replace(lower(segs[2]), '[0-9]+', '0', 'g') end,
'depth:' || cast(len(segs) as varchar), 'end:' || case when regexp_matches(path, '[.][A-Za-z0-9]{{1,5}}$') then lower(regexp_extract(path, '[.]([A-Za-z0-9]{{1,5}})$', 1)) when ends_with(path, '/') then '/' else '-' end,
case when keys <> '' then 'keys:' || keys end], lambda x: x is not null)) end as tokens from s),
lab as (select tokens, ruled, count(*) as c from k where ruled is not null and len(tokens) > 0 group by all),
total as (select sum(c) as n from lab),
sub as (select list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) as tokens, ruled, c from (select *, unnest(range(1, 1 << len(tokens))) as m from lab)),
whole as (select tokens, sum(c) as n_all from sub group by tokens),
part as (select tokens, ruled as verdict, sum(c) as freq from sub group by tokens, ruled having sum(c) >= (select ceil({MIN_SUPPORT} * n) from total)),
prior as (select ruled as verdict, sum(c) / (select n from total) as share from lab group by ruled),
cand as (select array_to_string(tokens, ' ') as rule_id, tokens, verdict, freq / n_all as confidence, freq as support from part join whole using (tokens) join prior using (verdict) where freq / n_all >= {MIN_CONFIDENCE} and freq / n_all >= {MIN_LIFT} * share),
beaten as (select distinct s.rule_id, s.verdict from (select *, unnest(tokens) as gone from cand where len(tokens) > 1) s join cand o on o.verdict = s.verdict and o.confidence >= s.confidence and o.rule_id = array_to_string(list_filter(s.tokens, lambda x: x <> s.gone), ' ')),
rules as (select * from cand anti join beaten using (rule_id, verdict)),
kinds as (select distinct tokens from k where ruled is null),
best as (select kinds.tokens, max({{'c': confidence, 's': support, 'v': verdict, 'r': rule_id}}) as b from kinds join rules on list_has_all(kinds.tokens, rules.tokens) group by kinds.tokens),
major as (select max({{'n': n, 'v': ruled}}) as m from (select ruled, sum(c) as n from lab group by ruled))
select page_id, host, path, rule, coalesce(ruled, b.v, m.v, 'allow') as verdict, case when ruled is null then b.r end as mined_rule, case when ruled is null then b.c end as confidence from k left join best using (tokens) cross join major"""
