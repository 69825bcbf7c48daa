"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, language_id, quality_rules, url_filter
from .bpe import encode_texts
from .common import spread, table
from .near_duplicates import near_duplicates
from .packing import pack
from .repeats import remove_repeats
from .token_counts import count_tokens


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return remove_repeats(docs).select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def chat_log(messages: DataFrame) -> DataFrame:
    """The events that messages (conv_id, turn, role, text) come about by: an
    assistant's first answer grows by a delta, is thrown away and regenerated,
    and streamed anew in three deltas; others' messages are edited twice, the
    second time to what they were. Rows of one turn are messages of their own."""
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    third = F.ceil(n / 3).cast("int")
    event = lambda kind, said: F.struct(F.lit(kind).alias("event"), said.cast("string").alias("said"))
    answer = [event("message", text), event("delta", F.lit(" [INST] and more")), event("regenerate", F.lit(None)), *(event("delta", F.substring(text, third * k + 1, third)) for k in range(3))]
    others = [event("message", text), event("edit", F.concat(F.lit("</s>"), F.substring(text, F.lit(1), third))), event("edit", text)]
    rows = messages.withColumn("message", F.monotonically_increasing_id())
    rows = rows.select("conv_id", "turn", "role", "message", F.posexplode(F.when(F.col("role") == "assistant", F.array(*answer)).otherwise(F.array(*others))).alias("step", "e"))
    # all events of a turn come before the next turn's; a message's own follow each other
    seq = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 40))) * 8 + F.col("step")
    return rows.select("conv_id", seq.alias("seq"), "turn", "role", "message", F.col("e.event").alias("event"), F.col("e.said").alias("text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chats(chat_log(messages)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir, "doc_id", "text"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    labelled = docs.where(~language_id.held_out() & F.col("doc_id").isNotNull())
    model = language_id.learn(labelled, "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(F.col("_row.doc_id").alias("doc_id"), *quality_rules.COUNTS, "base_failed", "kept")


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_documents(spark, sf_dir, "doc_id", "text"), keep_ids=False).drop("ids")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir, "doc_id", "text"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), width=4, percent=80).drop("text_hash")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(*columns) if columns else docs, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_chat_formatting, op3_token_counts, op4_nearest_neighbours, op5_language_id, op6_quality_rules, op7_url_filter, op8_bpe, op9_packing, op10_near_duplicates)
}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{chat.escape(c)}')"
    return out


_CHAT_SQL = f"""
with log as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text), '')) as loss_sha256,
    cast(sum(length({_escaped("text")}) + length(replace({_escaped("role")}, chr(10), '\\n')) + {len(chat.START) + len(chat.END) + 2}) as bigint) as formatted_chars
from log group by conv_id
"""

_SUFFIXES = ", ".join(f"'{s}'" for s in url_filter.TWO_LABEL_SUFFIXES)


def _strength_sql(groups: str) -> str:
    """The strength of a level's prior; groups have n, bad and the level's mean m."""
    one = "lgamma(s * m + bad) - lgamma(s * m) + lgamma(s * (1 - m) + n - bad) - lgamma(s * (1 - m)) - lgamma(s + n) + lgamma(s)"
    return f"select arg_max(s, w) as s from (select s, coalesce(sum({one}) filter (n > 0), 0) + ln(s) - 2 * ln(1 + s) as w from grid left join {groups} on true group by s)"


_DEVIATE = f"{url_filter.DEVIATE!r}::double"
_URL_SQL = f"""
with parts as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
), outcomes as (
    select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels
    where doc_id is not null and (quality = 0 or toxic = 1 or (quality is not null and toxic is not null)) group by doc_id
), hosts as (
    select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as s from parts left join outcomes using (page_id) group by host
), split as (
    select host, n, bad, array_to_string(s[greatest(1, len(s) - 1):], '.') as two, array_to_string(s[greatest(1, len(s) - 2):], '.') as three, s[len(s)] as one from hosts
), named as (
    select host, n, bad, case when two in ({_SUFFIXES}) then three else two end as domain, case when two in ({_SUFFIXES}) then two else one end as suffix from split
), grid as (select unnest([{", ".join(f"{x}::double" for x in url_filter.STRENGTHS)}]) as s
), total as (select case when sum(n) > 0 then (sum(bad) + 1.0::double) / (sum(n) + 2) else 0.5::double end as m from named
), g1 as (select suffix, sum(n) as n, sum(bad) as bad, m from named, total group by suffix, m
), s1 as ({_strength_sql("g1")}
), l1 as (select suffix, (bad + s * m) / (n + s) as m from g1, s1
), g2 as (select domain, suffix, sum(n) as n, sum(bad) as bad, m from named join l1 using (suffix) group by domain, suffix, m
), s2 as ({_strength_sql("g2")}
), l2 as (select domain, suffix, (bad + s * m) / (n + s) as m from g2, s2
), g3 as (select host, n, bad, m from named join l2 using (domain, suffix)
), s3 as ({_strength_sql("g3")}
), beta as (select host, bad + s * m as a, greatest(0.5, n - bad + s * (1 - m)) as b from g3, s3 where n > 0
), terms as (select host, a, b, 1 / (9 * b) as u, 1 / (9 * a) as v from beta
), roots as (select host, a, b, u, v, sqrt(greatest(0, (1 - u) * (1 - u) * v + (1 - v) * (1 - v) * u - {_DEVIATE} * {_DEVIATE} * u * v)) as root, (1 - u) * (1 - u) - {_DEVIATE} * {_DEVIATE} * u as under from terms
), solved as (select host, b, a * pow(case when under > 0 then greatest(0, ((1 - u) * (1 - v) - {_DEVIATE} * root) / under) else 0 end, 3) as r from roots
), blocked as (select host from solved, total where r / (b + r) > m
), ruled as (
    select page_id, host, path, case
        when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
        when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
        when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from parts
)
select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' when rule is not null then 'allow'
    when host in (select host from blocked) then 'block' else 'allow' end as verdict from ruled
"""

_NEAR_SQL = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w
), n as (select doc_id, count(*) as n from s group by doc_id
), f as (select s, count(*) as f from s group by s having count(*) > 1
), p as (  -- of a set of n, n - ceil(0.8 n) + 1 of the rarest shingles meet those of any set that is near enough
    select doc_id, s from (select doc_id, s.s, n, row_number() over (partition by doc_id order by coalesce(f, 1), s.s) as r from s join n using (doc_id) left join f using (s))
    where r <= n - (4 * n + 4) // 5 + 1
), c as (select distinct a.doc_id as a, b.doc_id as b from p a join p b using (s) where a.doc_id < b.doc_id
), l as (
    select c.a, c.b from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and y.s = x.s join n na on na.doc_id = c.a join n nb on nb.doc_id = c.b
    group by c.a, c.b, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), e as (select a, b from l union all select b, a from l
), r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join e on r.b = e.a
), comp as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.component_id, d.doc_id) as component_id, coalesce(comp.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join comp using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op10_near_duplicates": _NEAR_SQL, "op2_chat_formatting": _CHAT_SQL, "op7_url_filter": _URL_SQL}
