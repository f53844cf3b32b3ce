"""The queries opN_<name> and their DuckDB SQL; each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .exact_dedup import exact_dedup
from .html_extract import html_extract
from .language_id import language_id
from .license_scan import GAP, LICENCE_FILE, MIN_COSINE, TERM, VERSION, YEAR, hint, idf_rows, license_scan, name_rows, part_rows, template_weights
from .ngram_jaccard import ngram_jaccard_join
from .packing import best_fit_pack, cut_pieces
from .quality_classifier import quality_classifier
from .quality_rules import LineRules, quality_rules

from .suffix_dedup import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(cut_pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, as_text=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; the query gives document 1234 of a source s the path /s/1/12/1234, so that directories lie within directories."""
    digits = F.col("doc_id").cast("string")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 2, F.lit(0)), F.lit(1)), lambda n: F.substr(digits, F.lit(1), n))
    folders = F.when(F.length(digits) > 2, above).otherwise(F.array().cast("array<string>"))
    path = F.concat(F.lit("/"), F.concat_ws("/", F.coalesce("source", F.lit("")), folders, digits))
    return license_scan(table(spark, sf_dir, "documents"), path)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


OP1_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents)
select doc_id, n_chars, text_sha256,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept
from d window w as (partition by text_sha256 order by n_chars desc, doc_id)
"""

_RULES = LineRules()
_BARE = "('|', '»', '›', '•', '·', '>', '/')"
OP7_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
win as (
  select doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2]) as k
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
rep as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (
  select doc_id, j, l, regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') as c,
         list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') as lw
  from (select doc_id, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as j from (select doc_id, string_split(t, chr(10)) as ls from d))
  where regexp_matches(l, '[^\x20\x09-\x0D]')),
judged as (
  select *, length(c) as n,
         (length(regexp_replace(l, '[^#*$%&|<>!\^~=_{{}}\[\]\\]+', '', 'g')) * 100 > length(c) * {_RULES.max_marks_percent})
         or len(list_filter(lw, lambda x: x in {_BARE})) >= {_RULES.min_bars}
         or len(list_filter(lw, lambda x: x in {_BARE})) * 100 > len(lw) * {_RULES.max_bars_percent}
         or regexp_matches(l, '{_RULES.boilerplate}') as bad
  from lines),
by_doc as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines,
         count(*) filter (where bad) as n_bad_lines, coalesce(sum(n) filter (where bad), 0) as lost_chars
  from judged group by doc_id),
r as (
  select d.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(n_lines, 0) as n_lines, coalesce(n_bad_lines, 0) as n_bad_lines, coalesce(lost_chars, 0) as lost_chars
  from d left join by_doc using (doc_id) left join rep using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       n_lines::bigint as n_lines, n_bad_lines::bigint as n_bad_lines, lost_chars::bigint as lost_chars,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars * 100 <= word_chars * {_RULES.max_lost_percent} as kept
from r
"""


_HINT = hint()
OP8_SQL = rf"""
with idfs(term, idf) as (values {idf_rows().replace("D)", "e0)")}),
parts(term, i, part) as (values {part_rows().replace("D)", "e0)")}),
names(i, name) as (values {name_rows()}),
d as (
  select doc_id, lower(coalesce(text, '')) as t,
         '/' || coalesce(source, '') || array_to_string(list_transform(range(1, greatest(length(doc_id::varchar) - 2, 0) + 1), lambda n: '/' || substring(doc_id::varchar, 1, n)), '') as dir
  from documents),
hinted as (select doc_id, dir, t, len(regexp_extract_all(t, '{TERM}')) as size from d where regexp_matches(t, '{_HINT}')),
segments as (
  select doc_id, dir, size, 'line' as kind, line, segment from (
    select doc_id, dir, size, unnest(range(0, len(ls))) as line, unnest(ls) as segment from (select *, string_split(t, chr(10)) as ls from hinted))
  union all
  select doc_id, dir, size, 'block' as kind, line, segment from (
    select doc_id, dir, size, unnest(range(0, len(ls))) as line, unnest(ls) as segment from (select *, regexp_split_to_array(t, '{GAP}') as ls from hinted)) where contains(segment, chr(10))),
terms as (
  select doc_id, dir, size, kind, line, regexp_replace(term, '{VERSION}', '\1') as term, count(*) as n
  from (select doc_id, dir, size, kind, line, unnest(regexp_extract_all(segment, '{TERM}')) as term from segments) group by all),
weighted as (
  select terms.*, case when regexp_matches(term, '{YEAR}') then 0 else n * coalesce(idf, {template_weights()[2]!r}) end as w from terms left join idfs using (term)),
norms as (select doc_id, dir, size, kind, line, sqrt(sum(w * w)) as norm, sum(n) as n_terms from weighted group by all),
dots as (select doc_id, kind, line, i, sum(w * part) as d from weighted join parts using (term) group by all),
scored as (select norms.*, i, round(d / norm, 4) as cosine from dots join norms using (doc_id, kind, line) where norm > 0),
own as (
  select scored.*, name as license, 2 * n_terms >= size or regexp_matches(doc_id::varchar, '{LICENCE_FILE}') as licence_file from scored join names using (i) where cosine >= {MIN_COSINE}
  qualify row_number() over (partition by doc_id order by cosine desc, i, kind, line) = 1),
licences as (
  select dir as above, license from (select dir, license, count(*) as n from own where licence_file group by dir, license)
  qualify row_number() over (partition by dir order by n desc, license) = 1),
dirs as (select distinct dir from d),
nearest as (
  select dir, above, license from dirs join licences on dir = above or starts_with(dir, above || '/')
  qualify row_number() over (partition by dir order by length(above) desc) = 1)
select d.doc_id, own.license, own.cosine, own.kind as segment, own.line::bigint as line, coalesce(own.licence_file, false) as licence_file,
       case when own.license is null then nearest.license end as inherited_license, case when own.license is null then above end as inherited_from
from d left join own using (doc_id) left join nearest on nearest.dir = d.dir
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_best_fit_packing, op4_language_id, op5_suffix_dedup, op6_quality_classifier, op7_quality_rules, op8_license_scan, op9_ngram_jaccard, op10_html_extract)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op7_quality_rules": OP7_SQL, "op8_license_scan": OP8_SQL}
