"""The driver queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.llm.common import Scratch, read_table


def tokenizer_file(name: str) -> str:
    """Where the installed public vocabularies have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.warc import archive_round_trip

    records = archive_round_trip(read_table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "frame", "frame_offset")


def op2_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.hnsw import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), Scratch(spark, "hnsw"), F.pmod("vec_id", F.lit(100)) == 0, k=10)


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.quality import judge, train

    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op4_suffix_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.substrings import remove_repeats

    cleaned = remove_repeats(read_table(spark, sf_dir, "documents"), Scratch(spark, "substrings"))
    # repeated passages in texts that are no copies: they keep half of their bytes or more
    passages = F.when(2 * F.col("n_removed") <= F.col("n_bytes"), F.col("n_spans")).otherwise(0).cast("long")
    # the same in words, whatever their bytes: passages of over 50 words that other documents have too
    shared = F.when(2 * F.col("n_shared_words") <= F.col("n_words"), F.col("n_shared_runs")).otherwise(0).cast("long")
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", passages.alias("n_passages"), "n_shared_words", shared.alias("n_shared_passages"))


def op5_bpe_rank_array(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from loculus.llm.bpe import round_trip

    coded = round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path or tokenizer_file("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.kdtree import kd_shards

    placed = kd_shards(read_table(spark, sf_dir, "documents"), Scratch(spark, "kdtree"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_dictionary_id_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from loculus.llm.idfiles import id_file_round_trip

    return id_file_round_trip(read_table(spark, sf_dir, "documents"), Scratch(spark, "idfiles"), tokenizer_path or tokenizer_file("word_bpe_49k.json"), end_id=1)


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.pii import FOUND, KINDS, SECRET, span_report

    report = span_report(read_table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    base, learned = [f"n_{k}" for k in KINDS], [f"n_{k}" for k in (SECRET, FOUND)]
    every = sum((F.col(c) for c in (*base, *learned)), F.lit(0).cast("long"))
    return report.select("doc_id", *base, F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", *learned, every.alias("n_spans"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), Scratch(spark, "mixing"))


def op10_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.simhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.lm import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "lm"))


def op12_summa_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.negatives import hard_negatives

    rows = read_table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", noisy), Scratch(spark, "negatives"), F.col("vec_id") % 100 == 0)


def op13_cartesian_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loculus.llm.trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"), Scratch(spark, "trie"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Mixing, restated: targets by repeated resharing, order and running sums by plain windows.
OP9_SQL = r"""
with sized as (
    select doc_id, case when source is null then '1' else '0' || source end as k,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5('mix|' || coalesce(doc_id::varchar, '')) as key
    from documents),
totals as (select k, sum(size)::bigint as source_size, (list_value(5.0, 2.0, 1.0)::double[])[((row_number() over (order by k) - 1) % 3 + 1)::int] as w from sized group by k),
levelled as (
    select *, 2.0::double * source_size as cap,
           (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
    from totals window o as (order by 2.0 * source_size / w, k rows between unbounded preceding and 1 preceding)),
targets as (select k, source_size, least(cap, coalesce(max(case when cap / w > level then level end) over () * w, cap)) as target from levelled),
budgets as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from targets),
running as (
    select s.*, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::bigint as rest,
           coalesce(sum(size) over (partition by s.k order by key, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from sized s join budgets b on s.k = b.k)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from running
"""


#: Hard negatives, restated: all scores of each anchor, and windows over them.
OP12_SQL = r"""
with sound as (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           [floor(256 * x::double) for x in embedding] as parts
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scores as (
    select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, list_dot_product(a.parts, b.parts)::bigint as score
    from sound a join sound b on a.r <> b.r where a.vec_id % 100 = 0),
positives as (
    select *, row_number() over (partition by r order by score desc, vec_id) as place from scores where alike qualify place <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.r, p.place order by n.score desc, n.vec_id) as rank,
       n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on n.r = p.r and not n.alike and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""


#: The trie, restated: every prefix of every rebuilt conversation as a list, grouped; the checksum is computed bit by bit.
OP13_SQL = r"""
with own as (
    select conv_id as conv, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
           md5(coalesce(role, '')) || md5(coalesce(text, '')) as said, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words
    from conversations where conv_id is not null),
ids as (
    select conv, conv - conv % 20 as head,
           xor(list_reduce(list_concat([4294967295::bigint], range(8 * length(conv::varchar))), lambda acc, k:
               xor((xor(acc, case when k % 8 = 0 then ascii(substr(conv::varchar, k // 8 + 1, 1))::bigint else 0 end)) >> 1,
                   case when xor(acc, case when k % 8 = 0 then ascii(substr(conv::varchar, k // 8 + 1, 1))::bigint else 0 end) & 1 = 1 then 3988292384 else 0 end)),
               4294967295) % 4 as h
    from (select distinct conv from own)),
parts as (
    select i.conv, 0 as part, o.pos, o.said, o.words from ids i join own o on o.conv = i.head and o.pos <= i.h
    union all select i.conv, 1, o.pos, o.said, o.words from ids i join own o on o.conv = i.conv and o.pos > i.h),
sequences as (
    select ids.conv, coalesce(list({'said': said, 'words': words} order by part, pos) filter (where pos is not null), []) as turns
    from ids left join parts using (conv) group by ids.conv),
members as (select conv, unnest(range(len(turns) + 1)) as depth, turns from sequences),
nodes as (
    select turns[1:depth] as prefix, depth, min(conv) as conv_id, count(*) as n_convs,
           sha256(coalesce(string_agg(conv::varchar, ',' order by conv) filter (where len(turns) = depth), '')) as ends_sha256
    from members group by 1, 2),
linked as (select n.*, p.conv_id as parent_conv_id from nodes n left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]),
children as (select prefix[1:depth - 1] as prefix, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2),
counted as (select l.*, coalesce(c.n_children, 0) as n_children from linked l left join children c using (prefix, depth)),
spread as (select prefix, depth, unnest(range(depth + 1)) as top, n_convs, n_children from counted),
below as (
    select prefix[1:top] as prefix, top as depth, sum((n_children = 0)::int) as n_leaves,
           sum((n_convs - 1) * case when depth > 0 then prefix[depth].words else 0 end) as saved_tokens
    from spread group by 1, 2)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
from counted join below using (prefix, depth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": OP9_SQL, "op12_summa_negatives": OP12_SQL, "op13_cartesian_trie": OP13_SQL}
