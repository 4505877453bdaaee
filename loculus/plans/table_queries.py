"""Ingest, publication and hierarchy operations over the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.operators import publish
from loculus.plans.bindings import table
from loculus.plans.catalogue import query


@query(
    r"""select page_id, url, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) as host, split_part(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/', 1) as first, len(string_split(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/')) as depth from pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(1)).alias("host"),
        F.split_part(path, F.lit("/"), F.lit(1)).alias("first"),
        F.size(F.split(path, "/")).cast("long").alias("depth"),
    )


@query("select url, min(page_id) as pos from pages group by 1")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.first_urls(table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("pos")))


@query("select url from pages except select url from pages where page_id % 3 <> 0")
def extra_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return publish.leftovers(pages, pages.where("page_id % 3 <> 0"), "url")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.not_yet_done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""with files as (select doc_id, 'repo/' || source || '/' || doc_id || '.xml' as path,
    case when doc_id % 10 = 9 then null else 'urn:cts:x:' || md5(text) || '.w.v' end as urn
    from documents)
select path, urn from files where urn is null union all select min(path), urn from files where urn is not null group by urn""")
def dedupe_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    urn = F.when(F.col("doc_id") % 10 != 9, F.concat(F.lit("urn:cts:x:"), F.md5(F.col("text").cast("binary")), F.lit(".w.v")))
    files = docs.select(F.concat(F.lit("repo/"), "source", F.lit("/"), "doc_id", F.lit(".xml")).alias("path"), urn.alias("urn"))
    return publish.keep_canonical(files).select("path", "urn")


@query("""select case when l.doc_id is null then 'skipped' when quality = 0 then 'failed' when n_chars < 200 then 'no-schema'
    else 'ok' end as status, count(*) as n
from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels").withColumn("known", F.lit(True)),
        "doc_id",
        "left",
    )
    status = F.when(F.col("known").isNull(), "skipped").when(F.col("quality") == 0, "failed").when(
        F.col("n_chars") < 200,
        "no-schema",
    ).otherwise("ok")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("select doc_id % 10 as shard, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def shard_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.pmod("doc_id", F.lit(10)).alias("shard")).agg(
        F.count("*").alias("n"),
        F.sum("n_chars").alias("chars"),
    )


#: DuckDB has no CRC-32; this one takes a URL bit by bit.
_STEP_SQL = "xor(crc, case when k % 8 = 0 then ascii(substr(url, k // 8 + 1, 1))::bigint else 0 end)"


@query(f"""select page_id, url, (xor(list_reduce(list_concat([4294967295::bigint], range(8 * length(url))),
    lambda crc, k: xor({_STEP_SQL} >> 1, case when {_STEP_SQL} & 1 = 1 then 3988292384 else 0 end)), 4294967295) % 10)::int as shard from pages""")
def crc32_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", publish.crc_shard(F.col("url"), 10).alias("shard"))


@query("""with a as (select user_id, max(cast(props ->> '$.k' as bigint)) as old from events where event_type = 'click' group by 1),
b as (select user_id, max(cast(props ->> '$.k' as bigint)) as new from events where event_type = 'view' group by 1)
select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id is null then 'added' when b.user_id is null then 'removed'
    else 'changed' end as change
from a full join b on a.user_id = b.user_id where a.user_id is null or b.user_id is null or old is distinct from new""")
def digest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    at = lambda kind: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("k").alias("k"))
    return publish.digest_changes(at("click"), at("view"), "user_id", "k")


@query("""select r_name, n_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders, round(sum(o_totalprice), 2) as total
from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey
    join orders on o_custkey = c_custkey group by rollup (r_name, n_name)""")
def nested_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: table(spark, sf_dir, n)
    # orders are summed per customer before they meet the small tables
    per_customer = read("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    joined = per_customer.join(
        read("customer").select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(
        F.count_distinct("c_custkey").alias("customers"),
        F.sum("orders").alias("orders"),
        F.round(F.sum("total"), 2).alias("total"),
    )


@query(
    """select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id
    order by turn) as section from conversations"""
)
def running_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order).alias("section"),
    )
