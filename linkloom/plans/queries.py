"""Queries over the tables of a folder, by name, with DuckDB SQL that gives the same rows where SQL can.

``pages.url`` stands for a crawl: its records are the candidates, and ranked domains, sources and copies are derived from it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from linkloom.functions import urls as U
from linkloom.functions import v0
from linkloom.functions.coders import AdaptivePPM, StaticPPM
from linkloom.operators import corpus, models, ngrams, stats
from linkloom.sources import corpus_files, files, ppm_model
from linkloom.sources.scratch import new_folder, written
from linkloom.streaming import collect

Query = Callable[[SparkSession, str], DataFrame]

SCHEME_SQL = f"lower(regexp_extract(url, '{U.SCHEME}', 1))"
HOST_PORT_SQL = f"regexp_replace(regexp_extract(url, '{U.AUTHORITY}', 1), '^.*@', '')"
HOST_SQL = f"translate(regexp_extract({HOST_PORT_SQL}, '{U.HOST}', 1), '[]', '')"
PORT_SQL = f"try_cast(nullif(regexp_extract({HOST_PORT_SQL}, '{U.PORT}', 1), '') as int)"
PATH_SQL = f"regexp_extract(url, '{U.PATH}', 1)"
QUERY_SQL = f"nullif(regexp_extract(url, '{U.QUERY}', 1), '')"
FRAGMENT_SQL = f"regexp_extract(url, '{U.FRAGMENT}', 1)"
U_SQL = f"u as (select url, lower({HOST_SQL}) as domain, {SCHEME_SQL} as url_protocol, {PATH_SQL} as url_path, {QUERY_SQL} as url_query, {PORT_SQL} as url_port from pages)"
COLUMNS = "url, domain, url_protocol, url_path, url_query, url_port"
WANTED = "url is not null and domain is not null and url_protocol in ('http', 'https') and length(url) <= 4096"
EXCLUDED = ", ".join(f"'{p}'" for p in corpus.EXCLUDED_PATHS)
ALLOWED = f"(url_path is null or url_path not in ({EXCLUDED}))"
#: The list holds the hosts that any of their pages is fetched from by https.
LISTED_SQL = f"{U_SQL}, listed as (select distinct domain from u where url_protocol = 'https')"
SCORE_SQL = "(case when url_query is not null and url_query <> '' then 100 else 0 end + length(coalesce(url_path, '')) + length(regexp_replace(coalesce(url_path, ''), '[^/]', '', 'g')) + length(url) / 1000.0::double)"
TRAIN_SQL = "cast('0x' || substr(sha256(url), 1, 8) as bigint) % 100 < 90"
TOP_N, VOCABULARY_MIN = 100, 2


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.url_records(pages(spark, sf_dir))


def listed_domains(own: DataFrame) -> DataFrame:
    """Stands for the rank list, which the tables don't have: hosts with a page fetched by https."""
    return own.filter("url_protocol = 'https'").select("domain").distinct()


def sources(own: DataFrame) -> DataFrame:
    """Candidates dealt to eight sources, as files of a crawl would hold them."""
    return own.withColumn("source", F.substring(F.md5(F.concat(F.lit("s"), "url")), 1, 1))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("url").filter(corpus.in_training(F.col("url"), models.TRAIN_PERCENT))


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.context_model(models.context_counts(training(spark, sf_dir)))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(F.col("page_id").alias("url_id"), "url")


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# --- filters -----------------------------------------------------------------------------------------------------------

query("url_records", records, f"with {U_SQL} select {COLUMNS} from u")
query("url_filter", lambda s, d: corpus.wanted_urls(records(s, d)), f"with {U_SQL} select {COLUMNS} from u where {WANTED}")


def _with_special_paths(own: DataFrame) -> DataFrame:
    """The candidates, and one for each host that asks for its robots file."""
    robots = own.select("domain").distinct().select(F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")).alias("url"))
    return own.unionAll(U.url_records(robots))


SPECIAL_SQL = f"{U_SQL}, r as (select 'https://' || domain || '/robots.txt' as url from (select distinct domain from u)), w as (select {COLUMNS} from u union all select url, lower({HOST_SQL}), {SCHEME_SQL}, {PATH_SQL}, {QUERY_SQL}, {PORT_SQL} from r)"
query("excluded_paths", lambda s, d: corpus.without_excluded_paths(_with_special_paths(records(s, d))), f"with {SPECIAL_SQL} select {COLUMNS} from w where {ALLOWED}")


def raw_rank_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank list whose lines have last dots, blanks, capital letters and ranks that aren't numbers."""
    p = pages(spark, sf_dir)
    host = U.host(F.col("url"))
    column0 = F.when(F.col("page_id") % 7 == 0, F.lit("rank")).otherwise(F.col("page_id").cast("string"))
    column1 = F.when(F.col("page_id") % 5 == 0, F.lit("  ")).when(F.col("page_id") % 3 == 0, F.concat(F.upper(host), F.lit("."))).otherwise(F.concat(F.lit(" "), host))
    return p.select(column0.alias("column0"), column1.alias("column1"))


query(
    "rank_list_clean",
    lambda s, d: corpus.rank_list(raw_rank_list(s, d)),
    f"""with l as (select case when page_id % 7 = 0 then 'rank' else cast(page_id as varchar) end as column0,
                          case when page_id % 5 = 0 then '  ' when page_id % 3 = 0 then upper({HOST_SQL}) || '.' else ' ' || {HOST_SQL} end as column1 from pages)
        select cast(column0 as integer) as rank, lower(regexp_replace(trim(column1), '[.]$', '')) as domain
        from l where regexp_matches(column0, '^[0-9]+$') and column1 is not null and length(trim(column1)) > 0""",
)
query("train_test_split", lambda s, d: pages(s, d).select("url", corpus.in_training(F.col("url"), 90).alias("train")), f"select url, {TRAIN_SQL} as train from pages")

# --- corpus ------------------------------------------------------------------------------------------------------------

query("semi_join_ranked", lambda s, d: corpus.of_ranked_domains(records(s, d), listed_domains(records(s, d))), f"with {LISTED_SQL} select {COLUMNS} from u where exists (select 1 from listed l where l.domain = u.domain)")
query("dedup_url", lambda s, d: corpus.unique_urls(records(s, d).unionAll(records(s, d))), f"with {U_SQL}, d as (select * from u union all select * from u) select {COLUMNS} from d qualify row_number() over (partition by url order by {COLUMNS}) = 1")
query("distinct_candidates", lambda s, d: corpus.distinct_candidates(records(s, d).unionAll(records(s, d))), f"with {U_SQL} select distinct url, domain, url_path from u where {WANTED} and length(url) > 0 and {ALLOWED}")


def crawl_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The candidates as four files of a crawl."""
    folder, own = new_folder(spark, "crawl"), records(spark, sf_dir)
    rows = own.select("url", F.col("domain").alias("url_host_registered_domain"), "url_protocol", "url_path", "url_query", "url_port", F.concat(F.lit("file-"), F.conv(F.substring(F.md5("url"), 1, 1), 16, 10).cast("int") % 4).alias("file"))
    rows.write.partitionBy("file").parquet(folder)
    return [f"{folder}/file=file-{k}" for k in range(4) if files.exists(spark, f"{folder}/file=file-{k}")]


def collected(spark: SparkSession, sf_dir: str, quota: int) -> DataFrame:
    """A whole collection: crawl files to shards, state, ranked rows, and the corpus as text. Half of the eligible URLs are wanted, and all files are asked for."""
    found, listed = crawl_files(spark, sf_dir), listed_domains(records(spark, sf_dir))
    eligible = corpus.domain_ranks(corpus.unique_urls(corpus.of_ranked_domains(corpus.wanted_urls(records(spark, sf_dir)), listed)), quota).count()
    plan = collect.Plan(new_folder(spark, "collection"), "pages", found, target=eligible // 2, quota=quota, oversample=1000.0)
    collect.build(spark, plan, listed)
    return corpus_files.url_lines(spark, plan.urls_path)


def selection_queries(quota: int = corpus.DOMAIN_QUOTA, target: int = corpus.TARGET_URLS, per_source: int = corpus.PER_SOURCE) -> dict[str, tuple[Query, str]]:
    """The queries that have a limit: what runs, and its SQL. They are registered with the operators' own limits."""
    final = f"{U_SQL}, c as (select distinct url, domain, url_path from u where {WANTED} and length(url) > 0 and {ALLOWED}), q as (select url from c qualify row_number() over (partition by domain order by md5(url), url) <= {quota}), f as (select url from q order by md5(url), url limit {target})"
    ranked = f"{LISTED_SQL}, d as (select distinct {COLUMNS} from u where {WANTED} and domain in (select domain from listed)), r as (select {COLUMNS}, row_number() over (partition by domain order by {SCORE_SQL} desc, md5(url), url) as domain_rank from d)"

    def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Candidates of ranked domains, one row a URL, the most diverse of each domain, and of those the target's number."""
        own = records(spark, sf_dir)
        kept = corpus.domain_ranks(corpus.unique_urls(corpus.of_ranked_domains(corpus.wanted_urls(own), listed_domains(own))), quota)
        return corpus.first_by_hash(written(kept, "ranked"), target)

    def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus.select_training(records(spark, sf_dir), quota, target)

    return {
        "per_source_sample": (
            lambda s, d: corpus.sample_per_source(sources(records(s, d)), "source", per_source),
            f"with {U_SQL}, s as (select *, substr(md5('s' || url), 1, 1) as source from u) select {COLUMNS}, source from s qualify row_number() over (partition by source order by md5(url), url) <= {per_source}",
        ),
        "domain_quota_rank": (
            lambda s, d: corpus.domain_ranks(records(s, d), quota),
            f"with {U_SQL}, r as (select {COLUMNS}, row_number() over (partition by domain order by {SCORE_SQL} desc, md5(url), url) as domain_rank from u) select * from r where domain_rank <= {quota}",
        ),
        "quota_select": (
            lambda s, d: corpus.quota_by_hash(corpus.distinct_candidates(records(s, d)), quota),
            f"with {U_SQL}, c as (select distinct url, domain, url_path from u where {WANTED} and length(url) > 0 and {ALLOWED}) select * from c qualify row_number() over (partition by domain order by md5(url), url) <= {quota}",
        ),
        "final_selection": (selected, f"with {final} select url from f"),
        "build_corpus": (flagship, f"with {ranked} select * from r where domain_rank <= {quota} order by md5(url), url limit {target}"),
        "collect_corpus": (lambda s, d: collected(s, d, quota), f"with {ranked}, e as (select url from r where domain_rank <= {quota}) select url from e order by md5(url), url limit (select count(*) // 2 from e)"),
        "selection_report": (
            lambda s, d: corpus.selection_report(records(s, d), selected(s, d), quota, target).select("source.candidate_rows", "source.unique_urls", F.col("source.unique_domains").alias("source_domains"), "selection.target_urls", "selection.selected_urls", "selection.domain_quota", "selection.max_url_length", F.col("output.unique_domains").alias("output_domains")),
            f"""with {final}, s as (select count(*) as candidate_rows, count(distinct url) as unique_urls, count(distinct domain) as source_domains from u where {WANTED} and length(url) > 0),
                o as (select count(*) as selected_urls, count(distinct regexp_extract(url, '^(?:https?://)?([^/:?#]+)', 1)) as output_domains from f)
                select candidate_rows, unique_urls, source_domains, {target}::bigint as target_urls, selected_urls, {quota}::bigint as domain_quota, 4096::bigint as max_url_length, output_domains from s, o""",
        ),
        "available_urls": (lambda s, d: corpus.quota_by_hash(corpus.distinct_candidates(records(s, d)), quota).agg(F.count("*").alias("available")), f"with {final} select count(*) as available from q"),
        "host_distinct": (lambda s, d: selected(s, d).agg(F.countDistinct(corpus.host_of(F.col("url"))).alias("hosts")), f"with {final} select count(distinct regexp_extract(url, '^(?:https?://)?([^/:?#]+)', 1)) as hosts from f"),
    }


for _name, (_run, _sql) in selection_queries().items():
    query(_name, _run, _sql)

# --- sources and sinks -------------------------------------------------------------------------------------------------


def shards_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crawl file to a shard, those without a port (but the first) without that column, and all shards back as one table."""
    folder = new_folder(spark, "shards")
    for k, path in enumerate(crawl_files(spark, sf_dir)):
        rows = corpus_files.crawl_rows(spark, path)
        corpus_files.write_shard(rows if k == 0 or rows.filter("url_port is not null").limit(1).count() else rows.drop("url_port"), f"{folder}/shard-{k:04d}.parquet")
    return corpus_files.candidates(spark, folder).select(*COLUMNS.split(", "), F.regexp_extract(F.input_file_name(), "(shard-[0-9]+)", 1).alias("shard"))


def url_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{new_folder(spark, 'text')}/urls"
    corpus_files.write_urls(pages(spark, sf_dir), folder, pages(spark, sf_dir).count())
    return corpus_files.url_lines(spark, folder, blank=False)


def rank_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{new_folder(spark, 'ranks')}/list.csv"
    corpus_files.write_rank_lines(raw_rank_list(spark, sf_dir), folder)
    return corpus.rank_list(corpus_files.rank_lines(spark, folder))


SHARD_SQL = "cast('0x' || substr(md5(url), 1, 1) as int) % 4"
query("shards_roundtrip", shards_roundtrip, f"with {U_SQL}, k as (select f, row_number() over (order by f) - 1 as place from (select distinct {SHARD_SQL} as f from u)) select {COLUMNS}, 'shard-000' || place as shard from u join k on k.f = {SHARD_SQL}")
query("url_text_roundtrip", url_text_roundtrip, "select url from pages where url <> ''")
query("rank_csv_roundtrip", rank_csv_roundtrip, ORACLES["rank_list_clean"])

# --- statistics --------------------------------------------------------------------------------------------------------

_PERCENT = ", ".join(f"round(case when total_urls = 0 then 0.0 else 100.0 * {c} / total_urls end::double, 6) as {c}_percent" for c in ("https", "http", "urls_with_path", "urls_with_query", "urls_with_fragment"))
BASIC_SQL = f"""b as (select count(*) as total_urls, count(distinct domain) as unique_domains, count(*) filter (where lower(url_protocol) = 'https') as https,
          count(*) filter (where lower(url_protocol) = 'http') as http, count(*) filter (where url_path is not null and url_path <> '') as urls_with_path,
          count(*) filter (where url_query is not null and url_query <> '') as urls_with_query, count(*) filter (where position('#' in url) > 0) as urls_with_fragment from u),
        bs as (select *, {_PERCENT} from b)"""
LENGTH_SQL = """ls as (select coalesce(min(length(url)), 0)::bigint as min_length, coalesce(max(length(url)), 0)::bigint as max_length, round(coalesce(avg(length(url)), 0.0), 6) as mean_length,
       round(coalesce(quantile_cont(length(url), 0.5), 0.0)::double, 6) as p50, round(coalesce(quantile_cont(length(url), 0.9), 0.0)::double, 6) as p90,
       round(coalesce(quantile_cont(length(url), 0.95), 0.0)::double, 6) as p95, round(coalesce(quantile_cont(length(url), 0.99), 0.0)::double, 6) as p99 from pages where url is not null)"""
query("basic_stats", lambda s, d: stats.basic(records(s, d)), f"with {U_SQL}, {BASIC_SQL} select * from bs")
query("length_stats", lambda s, d: stats.lengths(records(s, d)), f"with {LENGTH_SQL} select * from ls")
TOP_SQL = f"select value, count(*) as count from v group by value order by count desc, value limit {TOP_N}"
VALUES_SQL = {
    "top_domains": "select domain as value from u where domain is not null",
    "top_path_segments": "select value from (select unnest(string_split(trim(url_path, '/'), '/')) as value from u) where value <> ''",
    "top_query_keys": "select lower(split_part(p, '=', 1)) as value from (select unnest(string_split(url_query, '&')) as p from u) where p <> ''",
}
for _name, _counts in (("top_domains", stats.domains), ("top_path_segments", stats.segments), ("top_query_keys", stats.query_keys)):
    query(_name, lambda s, d, f=_counts: stats.top(f(records(s, d)), TOP_N), f"with {U_SQL}, v as ({VALUES_SQL[_name]}) {TOP_SQL}")


def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's row, each of its lists as one text of value=count."""
    own = stats.report(records(spark, sf_dir), TOP_N)
    return own.select(*[F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), " ").alias(c) if c in VALUES_SQL else F.col(c) for c in own.columns])


_LISTS_SQL = ", ".join(f"(with v as ({v}), t as ({TOP_SQL}) select string_agg(value || '=' || count, ' ' order by count desc, value) from t) as {k}" for k, v in VALUES_SQL.items())

# --- n-grams -----------------------------------------------------------------------------------------------------------


def _grams_sql(orders: range, table: str, group: str = "'all'", text: str = "url") -> str:
    """g: the longest windows from each byte on, in hex, counted; n: those of each order, as their beginnings."""
    longest = 2 * (max(orders) + 1)
    # Long texts are cut into pieces first, as to find a place in a long text takes time.
    pieces = f"select grp, unnest(list_transform(generate_series(0, (length(h) - 1) // 2000), lambda j: struct_pack(p := substr(h, 2000 * j + 1, {2000 + longest - 2}), m := least(1000, length(h) // 2 - 1000 * j)))) as x from (select {group} as grp, hex(encode({text})) as h from {table}) where length(h) > 0"
    windows = f"select grp, unnest(list_transform(generate_series(1, x.m), lambda i: substr(x.p, 2 * i - 1, {longest}))) as w from ({pieces})"
    each = (f"select grp, {k} as k, substr(w, 1, {2 * k + 2}) as g, cast(sum(c) as bigint) as c from g where length(w) >= {2 * k + 2} group by grp, substr(w, 1, {2 * k + 2})" for k in orders)
    return f"g as (select grp, w, count(*) as c from ({windows}) group by grp, w), n as ({' union all '.join(each)})"


ENTROPY_SQL = """t as (select grp, sum(c) as t from n where k = 0 group by grp),
  e as (select n.grp, n.k, -sum(c / (t - n.k) * log2(c / a)) as h from (select *, sum(c) over (partition by grp, k, substr(g, 1, 2 * k)) as a from n) n join t on n.grp = t.grp group by n.grp, n.k)
  select t.grp as "group", cast(max(t) as bigint) as bytes, """ + ", ".join(f"round(coalesce(max(case when k = {k} then h end), 0.0), 6) + 0.0 as h{k}" for k in range(5)) + " from t left join e on t.grp = e.grp group by t.grp"

query("byte_entropy", lambda s, d: ngrams.entropies(ngrams.ngram_counts(pages(s, d), "url", [0]), [0]).select("bytes", F.col("h0").alias("byte_entropy")), f"with {_grams_sql(range(1), 'pages')} select cast(sum(c) as bigint) as bytes, round(-sum(c / t * log2(c / t)), 6) + 0.0 as byte_entropy from (select c, sum(c) over () as t from n)")
query("stats_report", stats_report, f"with {U_SQL}, {BASIC_SQL}, {LENGTH_SQL}, {_grams_sql(range(1), 'pages')}, be as (select round(-sum(c / t * log2(c / t)), 6) + 0.0 as byte_entropy from (select c, sum(c) over () as t from n)) select bs.*, ls.*, be.*, {_LISTS_SQL} from bs, ls, be")
query("byte_histogram", lambda s, d: ngrams.ngram_counts(pages(s, d), "url", [0]).select(F.col("gram").alias("byte"), F.col("n").alias("count")), f"with {_grams_sql(range(1), 'pages')} select cast('0x' || g as bigint) as byte, c as count from n")
query("ngram_entropy", lambda s, d: ngrams.entropies(ngrams.ngram_counts(pages(s, d), "url", range(5))), f"with {_grams_sql(range(5), 'pages')}, {ENTROPY_SQL}")
query("ngram_distinct", lambda s, d: ngrams.distinct_ngrams(ngrams.ngram_counts(pages(s, d), "url", range(5))), f"with {_grams_sql(range(5), 'pages')} select k, count(*) as distinct_ngrams from n group by k")
query("document_byte_entropy", lambda s, d: ngrams.entropies(ngrams.ngram_counts(s.read.parquet(f"{d}/documents.parquet"), "text", range(5))), f"with {_grams_sql(range(5), 'documents', text='text')}, {ENTROPY_SQL}")

COMPONENT_SQL = f"""{U_SQL}, i as (select row_number() over () as id, * from u), p as (select id, unnest(string_split(url_query, '&')) as x from i where url_query is not null),
  q as (select id, url_decode(replace(split_part(x, '=', 1), '+', ' ')) as k, case when position('=' in x) > 0 then url_decode(replace(substr(x, position('=' in x) + 1), '+', ' ')) else '' end as v from p where x <> '' and position(';' in x) = 0),
  c as (select 'whole_url' as component, url as text from i union all select 'scheme', url_protocol from i union all select 'domain', {HOST_SQL} from i union all select 'path', url_path from i
        union all select 'fragment', url_decode(replace({FRAGMENT_SQL}, '+', '%2B')) from i union all select 'query_key', k from (select distinct id, k from q) union all select 'query_value', v from q)"""
query("component_entropy", lambda s, d: ngrams.entropies(ngrams.ngram_counts(ngrams.components(pages(s, d)), "text", range(5), "component")), f"with {COMPONENT_SQL}, {_grams_sql(range(5), 'c', 'component', 'text')}, {ENTROPY_SQL}")

# --- vocabularies --------------------------------------------------------------------------------------------------------

LABELS_SQL = f"{U_SQL}, v as (select value from (select unnest(string_split(lower({HOST_SQL}), '.')) as value from u) where value <> '')"
SEGMENTS_SQL = f"{U_SQL}, v as (select value from (select unnest(string_split(url_path, '/')) as value from u) where value <> '')"
KEYS_SQL = f"{U_SQL}, v as (select value from (select lower(split_part(p, '=', 1)) as value from (select unnest(string_split(url_query, '&')) as p from u) where p <> '') where value <> '')"
VOCABULARY_SQL = "select value, count(*) as count, row_number() over (order by count(*) desc, value) as rank from v group by value having count(*) >= {least} qualify rank <= {limit}"
for _name, _counts, _sql, _limit in (("vocab_domain_labels", models.label_counts, LABELS_SQL, models.LABEL_LIMIT), ("vocab_path_segments", models.segment_counts, SEGMENTS_SQL, models.SEGMENT_LIMIT), ("vocab_query_keys", models.key_counts, KEYS_SQL, models.KEY_LIMIT)):
    query(_name, lambda s, d, f=_counts, n=_limit: models.vocabulary(f(pages(s, d)), n, VOCABULARY_MIN), f"with {_sql} {VOCABULARY_SQL.format(least=VOCABULARY_MIN, limit=_limit)}")
query(
    "vocab_stats",
    lambda s, d: models.vocabulary_model(pages(s, d), VOCABULARY_MIN).select("urls", "n_domain_labels", "n_path_segments", "n_query_keys", F.size("domain_labels").alias("kept_domain_labels")),
    f"""select (select count(*) from pages) as urls, (with {LABELS_SQL} select count(distinct value) from v) as n_domain_labels, (with {SEGMENTS_SQL} select count(distinct value) from v) as n_path_segments,
        (with {KEYS_SQL} select count(distinct value) from v) as n_query_keys, (with {LABELS_SQL} select count(*)::int from (select value from v group by value having count(*) >= {VOCABULARY_MIN})) as kept_domain_labels""",
)

# --- context model -------------------------------------------------------------------------------------------------------

COUNTS_SQL = f"tr as (select url from pages where {TRAIN_SQL}), {_grams_sql(range(models.MAX_ORDER + 1), 'tr')}, cnts as (select k as ctx_order, case when k = 0 then 0 else cast('0x' || substr(g, 1, 2 * k) as bigint) end as ctx_key, cast('0x' || substr(g, 2 * k + 1, 2) as int) as symbol, c as cnt from n)"
MODEL_SQL = f"""{COUNTS_SQL}, kept as (select *, row_number() over (partition by ctx_order, ctx_key order by cnt desc, symbol) as place from cnts where ctx_order = 0 or cnt >= {models.PPM_MIN_COUNT}),
  m as (select ctx_order, ctx_key, symbol, cnt, place, cast(sum(cnt) over (partition by ctx_order, ctx_key) as bigint) as ctx_total, cast(sum(cnt) over (partition by ctx_order, ctx_key order by place) - cnt as bigint) as low, cast(sum(cnt) over (partition by ctx_order, ctx_key order by place) as bigint) as high
        from kept where ctx_order = 0 or place <= {models.TOP_K})"""
query("ppm_counts", lambda s, d: models.context_counts(training(s, d)), f"with {COUNTS_SQL} select * from cnts")
query("ppm_run_counters", lambda s, d: models.run_counters(pages(s, d)), f"with {COUNTS_SQL} select (select count(*) from pages where url <> '') as urls, (select count(*) from tr) as train_urls, (select cast(sum(c) as bigint) from n where k = 0) as train_bytes, (select count(*) from n) as entries")
query("ppm_model", lambda s, d: models.contexts(model(s, d)).select("ctx_order", "ctx_key", "ctx_total", F.size("symbols").alias("n_symbols"), F.array_join(F.transform("symbols", lambda x: F.concat_ws(":", x["symbol"], x["cnt"])), " ").alias("symbols")), f"with {MODEL_SQL} select ctx_order, ctx_key, max(ctx_total) as ctx_total, cast(count(*) as int) as n_symbols, string_agg(symbol || ':' || cnt, ' ' order by place) as symbols from m group by ctx_order, ctx_key")


def ppm_model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model through its binary file: a row for each symbol of a context, in coding order."""
    path, counters = f"{new_folder(spark, 'model')}/model.bin", models.run_counters(pages(spark, sf_dir)).first()
    ppm_model.save(models.contexts(model(spark, sf_dir)), path, models.MAX_ORDER, models.TRAIN_PERCENT, counters["urls"], counters["train_urls"])
    return ppm_model.load(spark, path).select("ctx_order", "ctx_key", "ctx_total", F.posexplode("symbols").alias("k", "s")).select("ctx_order", "ctx_key", "ctx_total", "s.symbol", "s.cnt", (F.col("k") + 1).cast("long").alias("place"))


query("ppm_model_file", ppm_model_file, f"with {MODEL_SQL} select ctx_order, ctx_key, ctx_total, symbol, cnt, place from m")
query("ppm_intervals", model, f"with {MODEL_SQL} select * from m")
POSITIONS_SQL = f"""b as (select page_id as url_id, hex(encode(url)) as h from pages), ps as (select url_id, h, unnest(generate_series(1, length(h) // 2)) as pos from b),
  po as (select url_id, pos, cast('0x' || substr(h, 2 * pos - 1, 2) as int) as symbol, o as ctx_order, case when o = 0 then 0 else cast('0x' || substr(h, 2 * (pos - o) - 1, 2 * o) as bigint) end as ctx_key
         from (select *, unnest(generate_series(0, least({models.MAX_ORDER}, pos - 1))) as o from ps))"""
query(
    "ppm_best_context",
    lambda s, d: models.best_contexts(numbered(s, d), model(s, d)).groupBy("best_order").agg(F.count("*").alias("positions")),
    f"with {MODEL_SQL}, {POSITIONS_SQL}, k as (select distinct ctx_order, ctx_key from m), f as (select url_id, pos, coalesce(max(case when k.ctx_order is not null then po.ctx_order end), -1) as best_order from po left join k on po.ctx_order = k.ctx_order and po.ctx_key = k.ctx_key group by url_id, pos) select best_order, count(*) as positions from f group by best_order",
)
query(
    "ppm_ideal_bits",
    lambda s, d: models.ideal_bits(numbered(s, d), model(s, d)),
    f"""with {MODEL_SQL}, {POSITIONS_SQL}, c as (select ctx_order, ctx_key, max(ctx_total) as t from m group by ctx_order, ctx_key),
        j as (select po.*, c.t, m.cnt, max(case when m.cnt is not null then po.ctx_order end) over (partition by url_id, pos) as hit from po left join c on po.ctx_order = c.ctx_order and po.ctx_key = c.ctx_key left join m on po.ctx_order = m.ctx_order and po.ctx_key = m.ctx_key and po.symbol = m.symbol),
        w as (select url_id, pos, sum(case when t is null then 0 when hit is null or ctx_order > hit then log2(t + 1) when ctx_order = hit then log2(t + 1) - log2(cnt) else 0 end) + case when max(hit) is null then 8 else 0 end as bits from j group by url_id, pos)
        select url_id, count(*) as n_bytes, round(sum(bits), 4) as bits from w group by url_id""",
)

# --- codecs ----------------------------------------------------------------------------------------------------------------

WWW_SQL = f"lower(substr({HOST_SQL}, 1, 4)) = 'www.'"
query(
    "semantic_flags",
    lambda s, d: pages(s, d).select("page_id", U.semantic(F.col("url")).alias("s")).select("page_id", "s.scheme", "s.host", "s.port", "s.path", "s.query", "s.fragment", "s.flags"),
    f"""select page_id, {SCHEME_SQL} as scheme, case when {WWW_SQL} then substr({HOST_SQL}, 5) else {HOST_SQL} end as host, {PORT_SQL} as port, {PATH_SQL} as path, {QUERY_SQL} as query, {FRAGMENT_SQL} as fragment,
        (case when {PORT_SQL} is not null then 1 else 0 end + case when {PATH_SQL} <> '' then 2 else 0 end + case when {QUERY_SQL} is not null then 4 else 0 end + case when {FRAGMENT_SQL} <> '' then 8 else 0 end + case when {WWW_SQL} then 16 else 0 end)::int as flags from pages""",
)

query(
    "semantic_inverse",
    lambda s, d: pages(s, d).select("url", U.semantic(F.col("url")).alias("s")).select("url", "s.flags", "s.host", U.semantic_url(F.col("s")).alias("again")),
    f"""select url, (case when {PORT_SQL} is not null then 1 else 0 end + case when {PATH_SQL} <> '' then 2 else 0 end + case when {QUERY_SQL} is not null then 4 else 0 end + case when {FRAGMENT_SQL} <> '' then 8 else 0 end + case when {WWW_SQL} then 16 else 0 end)::int as flags,
        case when {WWW_SQL} then substr({HOST_SQL}, 5) else {HOST_SQL} end as host,
        {SCHEME_SQL} || '://' || {HOST_SQL} || coalesce(':' || {PORT_SQL}, '') || {PATH_SQL} || coalesce('?' || {QUERY_SQL}, '') || case when {FRAGMENT_SQL} <> '' then '#' || {FRAGMENT_SQL} else '' end as again from pages""",
)


def _listed(words: list) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _word_bits(x: str, words: list[str], code: int) -> str:
    return f"case when {x} in {_listed(words)} then {code} else 7 + 8 * octet_length(encode({x})) end"


BITS_SQL = f"""with s as (select url, {SCHEME_SQL} as scheme, case when {WWW_SQL} then substr({HOST_SQL}, 5) else {HOST_SQL} end as host, {PORT_SQL} as port, {PATH_SQL} as path, {QUERY_SQL} as query, {FRAGMENT_SQL} as fragment from pages),
  i as (select *, regexp_replace(regexp_replace(path, '^/', ''), '/$', '') as inner_path from s)
  select url, (11 + case scheme when 'https' then 1 when 'http' then 2 when 'ftp' then 3 when 'ws' then 4 when 'wss' then 5 else 13 + 8 * octet_length(encode(scheme)) end
    + 5 + list_sum(list_transform(string_split(host, '.'), lambda x: {_word_bits('x', U.LABELS, 4)}))
    + case when port is null then 0 when port in (80, 443, 8080, 8443, 3000, 5000, 8000, 9000) then 4 else 17 end
    + case when path = '' then 0 when inner_path = '' then 7 else 7 + list_sum(list_transform(string_split(inner_path, '/'), lambda x: {_word_bits('x', U.SEGMENTS, 4)})) end
    + case when query is null then 0 else 5 + list_sum(list_transform(string_split(query, '&'), lambda x: {_word_bits("split_part(x, '=', 1)", U.KEYS, 6)} + 1 + case when position('=' in x) > 0 then 8 + 8 * octet_length(encode(substr(x, position('=' in x) + 1))) else 0 end)) end
    + case when fragment = '' then 0 when fragment in {_listed(U.FRAGMENTS)} then 4 else 9 + 8 * octet_length(encode(fragment)) end)::bigint as bit_len from i"""
query("v0_bit_length", lambda s, d: pages(s, d).select("url", U.v0_bits(U.semantic(F.col("url"))).alias("bit_len")), BITS_SQL)
query("v0_encode_bits", lambda s, d: pages(s, d).select("url", v0.v0_encode(F.col("url")).alias("e")).select("url", F.col("e.bit_len").cast("long").alias("bit_len")), BITS_SQL)


def _bits(x: str, n: int) -> str:
    return f"lpad(bin(({x})::bigint), {n}, '0')"


def _raw_bits(x: str, n: int) -> str:
    """A length of n bits, then the bytes."""
    byte = f"cast('0x' || substr(hex(encode({x})), 2 * i - 1, 2) as int)"
    size = f"octet_length(encode({x}))"
    return f"({_bits(size, n)} || array_to_string(list_transform(generate_series(1, {size}), lambda i: {_bits(byte, 8)}), ''))"


def _word_code(x: str, words: list[str], n: int, length: int) -> str:
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"case when {x} in {_listed(words)} then '0' || {_bits(f'list_position({listed}, {x}) - 1', n)} else '1' || {_raw_bits(x, length)} end"


_JOIN = "array_to_string(list_transform({}, lambda x: {}), '')"
#: The stream of each URL as a text of zeros and ones.
STREAM_SQL = f"""with s as (select page_id, url, {SCHEME_SQL} as scheme, case when {WWW_SQL} then 1 else 0 end as www, case when {WWW_SQL} then substr({HOST_SQL}, 5) else {HOST_SQL} end as host, {PORT_SQL} as port, {PATH_SQL} as path, {QUERY_SQL} as query, {FRAGMENT_SQL} as fragment from pages),
  l as (select *, string_split(host, '.') as labels, regexp_replace(regexp_replace(path, '^/', ''), '/$', '') as inner_path, string_split(query, '&') as pairs from s),
  i as (select *, case when inner_path = '' then []::varchar[] else string_split(inner_path, '/') end as segments from l),
  b as (select page_id, url, '000' || {_bits("case when port is null then 0 else 1 end + case when path = '' then 0 else 2 end + case when query is null then 0 else 4 end + case when fragment = '' then 0 else 8 end + 16 * www", 8)}
    || case scheme when 'https' then '0' when 'http' then '10' when 'ftp' then '110' when 'ws' then '1110' when 'wss' then '11110' else '11111' || {_raw_bits("scheme", 8)} end
    || {_bits("len(labels)", 5)} || {_JOIN.format("labels", _word_code("x", U.LABELS, 3, 6))}
    || case when port is null then '' when port in {tuple(U.PORTS)} then '0' || {_bits(f"list_position({U.PORTS}, port) - 1", 3)} else '1' || {_bits("port", 16)} end
    || case when path = '' then '' else case when path like '/%' then '1' else '0' end || case when regexp_replace(path, '^/', '') like '%/' then '1' else '0' end || {_bits("len(segments)", 5)} || {_JOIN.format("segments", _word_code("x", U.SEGMENTS, 3, 6))} end
    || case when query is null then '' else {_bits("len(pairs)", 5)} || {_JOIN.format("pairs", _word_code("split_part(x, '=', 1)", U.KEYS, 5, 6) + " || case when position('=' in x) > 0 then '1' || " + _raw_bits("substr(x, position('=' in x) + 1)", 8) + " else '0' end")} end
    || case when fragment = '' then '' else {_word_code("fragment", U.FRAGMENTS, 3, 8)} end as bits from i),
  z as (select *, length(bits) as n, rpad(bits, (8 * ((length(bits) + 7) // 8))::int, '0') as full_bits from b)"""
_NIBBLES = "[" + ", ".join(f"'{k:04b}'" for k in range(16)) + "]"
_HEX_SQL = f"array_to_string(list_transform(generate_series(0, length(full_bits) // 4 - 1), lambda k: substr('0123456789abcdef', list_position({_NIBBLES}, substr(full_bits, 4 * k + 1, 4)), 1)), '')"


def v0_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pages(spark, sf_dir).select("url", v0.v0_encode(F.col("url")).alias("e"))
    return coded.select("url", F.octet_length("e.data").cast("long").alias("n_bytes"), v0.v0_decode(F.col("e.data"), F.col("e.bit_len"))["url"].alias("decoded"))


query("v0_roundtrip", v0_roundtrip, f"{STREAM_SQL} select url, length(full_bits) // 8 as n_bytes, url as decoded from z")
query("v0_encode_hex", lambda s, d: pages(s, d).select("page_id", v0.v0_encode(F.col("url")).alias("e")).select("page_id", v0.envelope_hex(F.col("e")).alias("encoded")), f"{STREAM_SQL} select page_id, lpad(lower(to_hex(n)), 16, '0') || {_HEX_SQL} as encoded from z")


def coded_sizes(rows: DataFrame, coder: StaticPPM | AdaptivePPM) -> DataFrame:
    """url_id, url, n_bytes, decoded for each row: URLs that go through the coder and back. The model is broadcast; see static_coder."""
    sent = rows.sparkSession.sparkContext.broadcast(coder)

    @pandas_udf("n_bytes int, decoded string")  # type: ignore[call-overload]
    def there_and_back(urls: pd.Series) -> pd.DataFrame:
        streams = [sent.value.encode(u.encode()) if u else b"" for u in urls]
        return pd.DataFrame({"n_bytes": [len(x) for x in streams], "decoded": [sent.value.decode(x).decode() if x else u for x, u in zip(streams, urls, strict=True)]})

    return rows.select("url_id", "url", there_and_back("url").alias("c")).select("url_id", "url", "c.n_bytes", "c.decoded")


MODEL_BYTES = 2 << 30  # of a static model in a Python process, which bounds what is collected and broadcast
CONTEXT_BYTES, SYMBOL_BYTES = 400, 150  # about what each takes there


def static_coder(own: DataFrame, max_order: int = models.MAX_ORDER) -> StaticPPM:
    """The coder of a model that fits a process; a larger one needs a higher min_count or a lower top_k in context_model."""
    rows = models.contexts(own)
    n, symbols = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("symbols")), F.lit(0))).first()
    if (size := n * CONTEXT_BYTES + symbols * SYMBOL_BYTES) > MODEL_BYTES:
        raise ValueError(f"{n} contexts with {symbols} symbols take about {size >> 20} MB; {MODEL_BYTES >> 20} are allowed")
    return StaticPPM(max_order, {(r["ctx_order"], r["ctx_key"]): [(s["symbol"], s["cnt"]) for s in r["symbols"]] for r in rows.toLocalIterator()})


def static_ppm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_sizes(numbered(spark, sf_dir), static_coder(model(spark, sf_dir))).select("url", "n_bytes", "decoded")


ADAPTIVE_TRAINING = 500


def adaptive_ppm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coder starts from a model of all bytes and of the first ADAPTIVE_TRAINING URLs in random order, and learns on from there within each URL."""
    coder = AdaptivePPM()
    coder.update(bytes(range(256)))
    for r in corpus.first_by_hash(pages(spark, sf_dir).select("url"), ADAPTIVE_TRAINING).orderBy(*corpus.random_order()).toLocalIterator():
        coder.update(r["url"].encode())
    return coded_sizes(numbered(spark, sf_dir), coder).select("url", "decoded")


#: The range coder as a recursion: intervals of each URL in order, then one narrowing or one bit a step. Longer contexts come first.
SIZES_SQL = f"""with recursive {MODEL_SQL}, {POSITIONS_SQL}, c as (select ctx_order, ctx_key, max(ctx_total) as t from m group by ctx_order, ctx_key),
  j as (select po.*, c.t, m.low, m.high, max(case when m.cnt is not null then po.ctx_order end) over (partition by url_id, pos) as hit, row_number() over (partition by url_id, pos order by po.ctx_order) as last
        from po left join c on po.ctx_order = c.ctx_order and po.ctx_key = c.ctx_key left join m on po.ctx_order = m.ctx_order and po.ctx_key = m.ctx_key and po.symbol = m.symbol),
  op as (select url_id, pos, ctx_order as o, t as lo, t + 1 as hi, t + 1 as total from j where t is not null and (hit is null or ctx_order > hit)
         union all select url_id, pos, ctx_order, low, high, t + 1 from j where ctx_order = hit
         union all select url_id, pos, -1, symbol, symbol + 1, 256 from j where hit is null and last = 1),
  li as (select url_id, list({{'lo': lo::bigint, 'hi': hi::bigint, 'total': total::bigint}} order by pos, o desc) as ops from op group by url_id),
  r(url_id, ops, k, a, b, w, n, done) as (
    select url_id, ops, 0, 0::bigint, 4294967295::bigint, 0, 0, false from li
    union all
    select url_id, ops, case when act = 'code' then k + 1 else k end,
           case act when 'code' then a + (b - a + 1) * ops[k + 1].lo // ops[k + 1].total when 'low' then 2 * a when 'high' then 2 * (a - 2147483648) when 'middle' then 2 * (a - 1073741824) else a end,
           case act when 'code' then a + (b - a + 1) * ops[k + 1].hi // ops[k + 1].total - 1 when 'low' then 2 * b + 1 when 'high' then 2 * (b - 2147483648) + 1 when 'middle' then 2 * (b - 1073741824) + 1 else b end,
           case act when 'middle' then w + 1 when 'low' then 0 when 'high' then 0 else w end,
           case act when 'low' then n + 1 + w when 'high' then n + 1 + w else n end, act = 'end'
    from (select *, case when b < 2147483648 then 'low' when a >= 2147483648 then 'high' when a >= 1073741824 and b < 3221225472 then 'middle' when k < len(ops) then 'code' else 'end' end as act from r where not done)),
  sz as (select url_id, (4 + (n + w + 2 + 7) // 8)::int as n_bytes from r where done)"""
query("static_ppm_sizes", lambda s, d: coded_sizes(numbered(s, d), static_coder(model(s, d))).select("url_id", "n_bytes"), f"{SIZES_SQL} select url_id, n_bytes from sz")
query("static_ppm_roundtrip", static_ppm_roundtrip, f"{SIZES_SQL} select p.url, n_bytes, p.url as decoded from sz join pages p on p.page_id = sz.url_id")
query("adaptive_ppm_roundtrip", adaptive_ppm_roundtrip, "select url, url as decoded from pages")
