"""Queries over the test tables; each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.llm import binfill, credentials, encode, handwritten, nearcopies, neighbours, spans, splitting
from corvex.shared import table, written


def _limited(spark: SparkSession, d: str) -> DataFrame:
    return splitting.with_limits(table(spark, d, "stored_files"), table(spark, d, "split_limits"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.piece_kinds(_limited(spark, d), "file_id", "content", F.col("_max"), F.col("_overlap")).distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    files = _limited(spark, d).dropDuplicates(["file_id"])
    return splitting.split_texts(files, "file_id", "content", F.col("_max"), F.col("_overlap"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearcopies.similar_pairs(table(spark, d, "stored_files"), "file_id", "content", share=0.7, width=3, least_words=40)
    return pairs.toDF("file_a", "file_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.similar_groups(table(spark, d, "stored_files"), "file_id", "content", share=0.7, width=3, least_words=40)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_pairs(table(spark, d, "hnsw_nodes"), "node_id", "vector", k=10, radius=0.15).toDF("node_a", "node_b")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "hnsw_nodes"), "node_id", "vector", k=10)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(table(spark, d, "stored_files"), path="path").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact(table(spark, d, "stored_files").dropDuplicates(["file_id"]), path="path")


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "stored_files"), table(spark, d, "indexer_config"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_reasons(spark, d).select("file_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Of every row of pack_limits; the documents are counted once for each tokenizer."""
    documents, out, counted = table(spark, d, "documents"), None, {}
    for limit in table(spark, d, "pack_limits").where("capacity_tokens > 0 and tokenizer is not null").dropDuplicates(["pack_id"]).collect():  # a settings table
        name = limit["tokenizer"]
        if name not in counted:
            counted[name] = written(encode.token_counts(documents, "doc_id", "text", name).where("n_tokens > 0"), "counts")
        filled = binfill.fill_containers(counted[name], limit["capacity_tokens"]).withColumn("pack_id", F.lit(limit["pack_id"]))
        out = filled if out is None else out.unionByName(filled)
    if out is None:
        return spark.createDataFrame([], "pack_id int, container long, doc_id long, part_no int, token_from long, token_to long")
    return out.select("pack_id", "container", "doc_id", "part_no", "token_from", "token_to")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"), "doc_id", "text", length=200)


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    shared = p10_found(spark, d).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    documents = table(spark, d, "documents").select("doc_id", "n_chars").dropDuplicates(["doc_id"])
    share = F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)).otherwise(F.lit(0.0))
    return documents.join(shared, "doc_id", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("bigint"))).select("doc_id", "n_chars", "n_shared", share.alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p4_found, p4_neighbours, p5_found, p5_redacted, p6_found, p6_reasons, p8_ids, p9_containers, p10_found, p10_shares)}

_SHARED = """
with docs as (select doc_id, text from documents where length(text) >= 200),
runs as (select doc_id, s, md5(substr(text, s + 1, 200)) as h from (select doc_id, text, unnest(range(0, length(text) - 199)) as s from docs)),
found as (select h from runs group by h having count(distinct doc_id) > 1),
spot as (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from runs where h in (select h from found)),
grouped as (select doc_id, s, sum(case when before is not null and s <= before + 200 then 0 else 1 end) over (partition by doc_id order by s) as run from spot),
spans as (select doc_id, min(s)::int as span_start, (max(s) + 200)::int as span_end from grouped group by doc_id, run)
"""

_SIMILAR = """
with words as (select distinct file_id, regexp_extract_all(lower(regexp_replace(content, '[^A-Za-z0-9_]', ' ', 'g')), '[a-z0-9_]+') as w from stored_files),
runs as (select distinct file_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run from (select file_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 40)),
sizes as (select file_id, count(*) as n from runs group by 1),
both_have as (select a.file_id as file_a, b.file_id as file_b, count(*) as m from runs a join runs b on a.run = b.run and a.file_id < b.file_id group by 1, 2),
pairs as (select file_a, file_b from both_have join sizes x on x.file_id = file_a join sizes y on y.file_id = file_b where 10 * m >= 7 * (x.n + y.n - m))"""

ORACLE = {
    "p2_found": _SIMILAR + " select file_a, file_b from pairs",
    "p10_found": _SHARED + "select doc_id, span_start, span_end from spans",
    "p10_shares": _SHARED
    + """, total as (select doc_id, sum(span_end - span_start)::bigint as n from spans group by 1)
select d.doc_id, d.n_chars, coalesce(n, 0)::bigint as n_shared, case when d.n_chars > 0 then round(coalesce(n, 0) / d.n_chars, 6) else 0.0 end as share
from (select distinct doc_id, n_chars from documents) d left join total using (doc_id)""",
    "p2_groups": _SIMILAR
    + """, links as (select file_a as a, file_b as b from pairs union all select file_b, file_a from pairs),
reach as (with recursive r(a, b) as (select distinct file_id, file_id from sizes union select r.a, l.b from r join links l on l.a = r.b) select a, min(b) as least from r group by 1)
select file_id, least as group_key, (select count(*) from links where a = file_id)::bigint as n_links from sizes join reach on a = file_id""",
    "p1_pieces": r"""
with recursive files as (
  select file_id, content, coalesce(l.max_chars, a.max_chars) as most, case when l.extension is not null then coalesce(l.overlap_chars, 0) else coalesce(a.overlap_chars, 0) end as over
  from (select distinct on (file_id) file_id, content, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\.([^.]*)$', 1)) as ext from stored_files) f
  left join split_limits l on l.extension = f.ext and l.extension <> '*' cross join (select * from split_limits where extension = '*') a),
long as (select file_id, content, over, most - over as budget from files where length(content) > most),
marked as (select file_id, content, over, budget, list_aggregate(list_transform(regexp_extract_all(content, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+'), lambda x: case when regexp_full_match(x, '[^\r\n]+') then regexp_replace(regexp_replace(x, '[^ \t]', 'c', 'g'), '[ \t]', 's', 'g')
  else regexp_replace(regexp_replace(left(x, length(x) - 1), '[^ \t\r]', 'c', 'g'), '[ \t\r]', 's', 'g') || case when regexp_full_match(x, '[ \t]*[\r\n]+') then 'b' else 'l' end end), 'string_agg', '') as cls from long),
cut(file_id, piece_no, spot, size, kind) as (
  select file_id, -1, 0, 0, '' from marked
  union all
  select file_id, piece_no + 1, from_at, case when rest <= budget then rest when strpos(back, 'b') > 0 then budget - strpos(back, 'b') + 1 when strpos(back, 'l') > 0 then budget - strpos(back, 'l') + 1 when strpos(back, 's') > 0 then budget - strpos(back, 's') + 1 else budget end,
    case when rest <= budget then 'end' when strpos(back, 'b') > 0 then 'blank_line' when strpos(back, 'l') > 0 then 'line' when strpos(back, 's') > 0 then 'space' else 'none' end
  from (select c.file_id, piece_no, spot + size as from_at, length(cls) - spot - size as rest, budget, reverse(substr(cls, spot + size + 1, budget)) as back from cut c join marked using (file_id)) where rest > 0)
select file_id, piece_no::int as piece_no, greatest(0, spot - over)::int as char_start, (spot + size - greatest(0, spot - over))::int as n_chars, kind as boundary_kind, substr(content, greatest(0, spot - over) + 1, spot + size - greatest(0, spot - over)) as piece
from cut join marked using (file_id) where piece_no >= 0""",
    "p1_found": r"""
with files as (
  select file_id, content, coalesce(l.max_chars, a.max_chars) as most, coalesce(l.max_chars, a.max_chars) - coalesce(l.overlap_chars, a.overlap_chars) as budget
  from (select distinct file_id, content, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\.([^.]*)$', 1)) as ext from stored_files) f
  left join split_limits l on l.extension = f.ext and l.extension <> '*' cross join (select * from split_limits where extension = '*') a),
long as (select * from files where length(content) > most),
pieces as (
  select file_id, budget, regexp_extract_all(content, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+') as lines, regexp_extract_all(content, '[^ \t\r\n]*[ \t\r\n]|[^ \t\r\n]+') as words from long),
spot as (select file_id, budget, i, length(lines[i]) as n, regexp_full_match(lines[i], '[ \t]*[\r\n]+') as blank from (select *, unnest(range(1, len(lines) + 1)) as i from pieces)),
blocks as (select file_id, sum(n) as n from (select *, coalesce(sum(blank::int) over (partition by file_id order by i rows between unbounded preceding and 1 preceding), 0) as b from spot) group by file_id, b),
widest as (
  select p.file_id, p.budget, (select max(n) from blocks x where x.file_id = p.file_id) as blocks, list_max(list_transform(lines, lambda x: length(x))) as lines, list_max(list_transform(words, lambda x: length(x))) as words
  from pieces p)
select file_id, case when blocks <= budget then 'blank_line' when lines <= budget then 'line' when words <= budget then 'space' else 'none' end as boundary_kind from widest""",
}
