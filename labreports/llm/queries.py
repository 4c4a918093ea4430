"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labreports.llm.blob_ledger import BASE, RULES, findings, scan_unseen
from labreports.llm.common import new_folder, table, written
from labreports.llm.decontaminate import benchmark_leaks
from labreports.llm.filter_audit import filter_audit
from labreports.llm.html_crf import main_text
from labreports.llm.line_windows import dedup_lines
from labreports.llm.maxent_lm import model_scores
from labreports.llm.pii import KINDS, joined, personal_data
from labreports.llm.quality import fit_quality, fold, score_quality
from labreports.llm.rp_forest import nearest
from labreports.llm.sentencepieces import encode_pieces
from labreports.llm.simhash import near_duplicates
from labreports.llm.spelling import spelling_variants
from labreports.llm.warc import assemble, captured, read_records, write_archives


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return benchmark_leaks(docs, items)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = written(scan_unseen(docs, "doc_id"), "ledger")

    def listed(found: Column) -> Column:
        return F.array_join(
            F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ","
        )

    def count(rule: str) -> Column:
        return F.size(F.filter("found", lambda x: x["rule"] == rule)).cast("long").alias(f"n_{rule}")

    base = F.filter("found", lambda x: x["rule"].isin(*BASE))
    return findings(docs, "doc_id", ledger).select(
        "doc_id",
        *map(count, BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_records(spark, path, with_blocks=False))
    return captures.select(
        captured("page_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        captured("refers_to_page").alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"),
        F.col("metadata").isNotNull().alias("has_metadata"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select("doc_id", held_out, "score", "predicted")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash": op3_simhash,
    "op4_neighbours": op4_neighbours,
    "op5_line_dedup": op5_line_dedup,
    "op6_main_text": op6_main_text,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_language_model": op11_language_model,
    "op12_spelling": op12_spelling,
    "op13_filter_audit": op13_filter_audit,
}

_LINE_DEDUP = r"""
with piece as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line,
         unnest(generate_series(1, len(string_split(text, chr(10))))) as nr
  from documents where text is not null
),
numbered as (
  select *, sum(case when regexp_matches(line, '[^ \t\n\x0B\f\r]') then 1 else 0 end)
              over (partition by doc_id order by nr) as unit
  from piece
),
line as (
  select doc_id, unit, string_agg(line, chr(10) order by nr) as line,
         row_number() over (partition by doc_id order by unit) - 1 as position
  from numbered group by doc_id, unit
),
trimmed as (
  select doc_id, position, regexp_replace(line, '[ \t\n\x0B\f\r]+$', '') as line from line
),
win as (
  select a.doc_id, a.position, a.line as l1, b.line as l2, c.line as l3
  from trimmed a
  join trimmed b on b.doc_id = a.doc_id and b.position = a.position + 1
  join trimmed c on c.doc_id = a.doc_id and c.position = a.position + 2
),
later as (
  select doc_id, position,
         row_number() over (partition by l1, l2, l3 order by doc_id, position) > 1 as again
  from win
),
gone as (
  select distinct doc_id, position + k as position
  from later, (values (0), (1), (2)) t(k) where again
)
select d.doc_id, coalesce(max(n.n), 1) as n_lines, coalesce(max(g.n), 0) as n_removed,
       case when max(g.n) is null then any_value(d.text) else coalesce(max(k.text), '') end as text
from documents d
left join (select doc_id, count(*) as n from line group by doc_id) n on n.doc_id = d.doc_id
left join (select doc_id, count(*) as n from gone group by doc_id) g on g.doc_id = d.doc_id
left join (
  select l.doc_id, string_agg(l.line, chr(10) order by l.position) as text
  from line l left join gone g on g.doc_id = l.doc_id and g.position = l.position
  where g.doc_id is null group by l.doc_id
) k on k.doc_id = d.doc_id
group by d.doc_id
"""

_SHINGLES = r"""
with source as (
  select 'd' as kind, doc_id as id, text from documents where text is not null
  union all select 'i', item_id, text from benchmark where text is not null
),
listed as (
  select kind, id, regexp_extract_all(
    regexp_replace(lower(text), '[\x{80}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}]', ' ', 'g'),
    '[0-9a-z\x{80}-\x{10ffff}]+') as w
  from source
),
shingle as (
  select distinct kind, id, unnest(
    case when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(generate_series(1, len(w) - 4),
                             lambda k: array_to_string(list_slice(w, k, k + 4), ' ')) end) as s
  from listed where len(w) > 0
),
item as (select id as item_id, s, count(*) over (partition by id) as n_shingles
         from shingle where kind = 'i')
select d.id as doc_id, item_id, count(*) as n_shared, cast(n_shingles as integer) as n_shingles,
       count(*) / n_shingles as containment
from shingle d join item using (s)
where d.kind = 'd'
group by d.id, item_id, n_shingles
having count(*) / n_shingles >= 0.8
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_WARC = f"""
with page as (
  select page_id, encode(coalesce(html, '')) as payload, sha1(encode(coalesce(html, ''))) as hex
  from pages
),
part as (
  select page_id, unnest([1, 2, 3, 4]) as nr,
         unnest([cast('0x' || substr(hex, 1 + 10 * k, 10) as bigint) for k in [0, 1, 2, 3]]) as v
  from page
),
digest as (
  select page_id, string_agg(
    array_to_string([substr('{_BASE32}', cast((v >> (35 - 5 * i)) & 31 as integer) + 1, 1)
                     for i in [0, 1, 2, 3, 4, 5, 6, 7]], ''), '' order by nr) as payload_digest
  from part group by page_id
)
select page_id, octet_length(payload) as payload_bytes, payload_digest,
       case when page_id = max(page_id) over (partition by payload) then 'response'
            else 'revisit' end as record_type,
       nullif(max(page_id) over (partition by payload), page_id) as refers_to,
       true as has_request, true as has_metadata
from page join digest using (page_id)
"""


def _secrets_sql() -> str:
    """The same rules in DuckDB, whose patterns have no possessive quantifiers or looking back."""
    scans = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("}+", "}").replace("++", "+").replace("(?<![0-9a-f])", "")
        pattern = pattern.replace("'", "''")
        scans.append(f"""
  select doc_id, {order} as ord, '{rule.name}' as rule, {rule.least} as least,
         unnest(string_split_regex(text, '{pattern}')[:-2]) as gap,
         unnest(regexp_extract_all(text, '{pattern}')) as whole,
         unnest(regexp_extract_all(text, '{pattern}', {rule.secret})) as secret,
         unnest(generate_series(1, len(regexp_extract_all(text, '{pattern}')))) as nr
  from documents where regexp_matches(text, '{pattern}')""")
    listed = "(" + ", ".join(f"'{name}'" for name in BASE) + ")"
    counts = ", ".join(f"count(*) filter (rule = '{name}') as n_{name}" for name in BASE)
    span = "rule || ':' || start || ':' || stop"
    return f"""
with hit as ({" union all ".join(scans)}),
placed as (
  select *, sum(length(gap) + length(whole)) over (partition by doc_id, ord order by nr) as stop
  from hit
),
span as (
  select doc_id, ord, rule, cast(stop - length(whole) as bigint) as start,
         cast(stop as bigint) as stop
  from placed where length(secret) >= least
)
select d.doc_id, {counts},
       sha256(coalesce(string_agg({span}, ',' order by start, ord)
                       filter (rule in {listed}), '')) as base_sha256,
       coalesce(string_agg({span}, ',' order by start, ord), '') as spans
from documents d left join span s on s.doc_id = d.doc_id
group by d.doc_id
"""


_SPELLING = r"""
with recursive crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1
                then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as entry
  from (select unnest(range(256)) as i)
),
run as (
  select coalesce(cast(doc_id as varchar), '') as doc,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents where text is not null
),
counted as (select doc, run, count(*) as times from run where length(run) >= 6 group by doc, run),
marked as (
  select run, times, xor(list_reduce(
           [cast('0x' || hex(encode(doc || ':' || run))[2 * k + 1 : 2 * k + 2] as bigint)
            for k in range(octet_length(encode(doc || ':' || run)))],
           lambda c, b: xor(c >> 8, entry[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) as h
  from counted, crc_table
),
word as (
  select word, cast(sum(times) as bigint) as n
  from (select times, case when h % 199 = 0
                then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                else run end as word from marked)
  where length(word) >= 6 group by word having sum(times) >= 5
),
hole as (
  select word, n, k, substr(word, 1, k) as head, substr(word, k + 2) as tail
  from (select word, n, unnest(range(length(word))) as k from word)
),
near as (
  select a.word, b.word as other, b.n as other_n
  from hole a join hole b using (head, tail) where a.word <> b.word
  union select a.word, b.word, b.n from hole a join word b on b.word = a.head || a.tail
  union select b.word, a.word, a.n from hole a join word b on b.word = a.head || a.tail
),
best as (
  select word, count(*) as n_near, max(other_n) as top,
         arg_min(other, (-other_n, other)) as other
  from near group by word
),
form as (
  select word.word, n, coalesce(n_near, 0) as n_near,
         case when top >= 5 * n then other end as form, case when top >= 5 * n then top end as form_n
  from word left join best on best.word = word.word
),
chain as (
  select word, word as root from form
  union all
  select chain.word, form.form from chain join form on form.word = chain.root
  where form.form is not null
)
select form.word, form.form, chain.root, form.n, form.n_near, form.form_n
from form join chain on chain.word = form.word
join form last on last.word = chain.root and last.form is null
"""

_FILTER_AUDIT = r"""
with text as (
  select d.doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         coalesce((select max(case when quality = 1 then 1 else 0 end) from labels l
                   where l.doc_id = d.doc_id), 0) as good,
         coalesce((select max(case when toxic = 1 then 1 else 0 end) from labels l
                   where l.doc_id = d.doc_id), 0) as toxic
  from documents d
),
word as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) as capitals,
         min(doc_id) over (partition by text) as least
  from text
),
failed as (
  select part, good, toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * capitals > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > least, false)] as fails
  from word
),
counted as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic
  from failed group by part, fails
),
letter as (select unnest([1, 2, 3, 4, 5]) as f, unnest(['A', 'B', 'C', 'D', 'E']) as name),
orders as (
  select a.name || b.name || c.name || d.name || e.name as filter_order,
         [a.f, b.f, c.f, d.f, e.f] as applied
  from letter a join letter b on b.f <> a.f join letter c on c.f not in (a.f, b.f)
  join letter d on d.f not in (a.f, b.f, c.f) join letter e on e.f not in (a.f, b.f, c.f, d.f)
),
step as (select filter_order, applied, unnest([1, 2, 3, 4, 5]) as step from orders),
met as (
  select part, filter_order, s.step, applied[s.step] as f, c.n, c.good, c.toxic,
         fails[applied[s.step]] as hit,
         list_bool_or([false] || [fails[x] for x in applied[1:s.step - 1]]) as gone,
         len([x for x in fails if x]) = 1 as single
  from counted c, step s
),
rows as (
  select part, filter_order, step, f,
         coalesce(sum(n) filter (not gone and not hit), 0) as kept,
         coalesce(sum(n) filter (not gone and hit), 0) as removed,
         coalesce(sum(n) filter (gone and hit), 0) as redundant,
         coalesce(sum(n) filter (hit and single), 0) as unique_fails,
         coalesce(sum(good) filter (not gone and hit), 0) as good_lost,
         coalesce(sum(toxic) filter (not gone and hit), 0) as toxic_lost
  from met group by part, filter_order, step, f
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept,
       cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from rows
"""


ORACLE_SQL: dict[str, str] = {
    "op12_spelling": _SPELLING,
    "op13_filter_audit": _FILTER_AUDIT,
    "op8_secrets": _secrets_sql(),
    "op9_warc": _WARC,
    "op1_decontamination": _SHINGLES,
    "op5_line_dedup": _LINE_DEDUP,
}
