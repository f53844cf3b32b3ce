"""Every query over the driver's tables with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, numbers, text
from ..operators import blocks, identifiers, kmers, repeats, runs, statistics
from ..sources.fixtures import CONTIGS_SQL, READS_SQL, contigs, reads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BLOCK = 1000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COMP = "translate({0}, 'ACGT', 'TGCA')"


def _v4(x: str) -> str:
    c = COMP.format(x)
    return f"least({x}, reverse({x}), {c}, reverse({c}))"


def _rc(x: str) -> str:
    return f"least({x}, reverse({COMP.format(x)}))"


def _kmers(k: int, keep: str = "read_id", table: str = "reads", seq: str = "seq") -> str:
    return f"kmers as (select * from (select {keep}, unnest(range(0, length({seq}) - {k - 1})) as pos, unnest(list_transform(range(1, length({seq}) - {k - 2}), lambda i: substring({seq}, i, {k}))) as kmer from {table}) where not regexp_matches(kmer, '[^ACGT]'))"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


# --- bases and scalar algebra


@query(_with(READS_SQL) + "select base, count(*) as n from (select unnest(string_split(seq, '')) as base from reads) group by base")
def base_composition(spark, d):
    return reads(spark, d).select(F.explode(F.split("seq", "")).alias("base")).where("base <> ''").groupBy("base").agg(F.count(F.lit(1)).alias("n"))


_GC = "length(regexp_replace(seq, '[^GC]', '', 'g'))"
_ACGT = "length(regexp_replace(seq, '[^ACGT]', '', 'g'))"


@query(_with(READS_SQL) + f"select read_id, round({_GC}::double / nullif({_ACGT}, 0), 4) as gc from reads")
def gc_content(spark, d):
    return reads(spark, d).select("read_id", F.round(dna.gc_content("seq"), 4).alias("gc"))


def _n(c: str) -> str:
    return f"(length(seq) - length(replace(seq, '{c}', '')))"


@query(_with(READS_SQL) + f"select read_id, round(({_n('A')} - {_n('T')})::double / nullif({_n('A')} + {_n('T')}, 0), 4) as at_skew, round(({_n('G')} - {_n('C')})::double / nullif({_n('G')} + {_n('C')}, 0), 4) as gc_skew from reads")
def at_gc_skew(spark, d):
    n = {c: F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit(""))) for c in "ACGT"}
    skew = lambda a, b: F.round((n[a] - n[b]) / F.nullif(n[a] + n[b], F.lit(0)), 4)
    return reads(spark, d).select("read_id", skew("A", "T").alias("at_skew"), skew("G", "C").alias("gc_skew"))


@query(_with(READS_SQL) + f"select read_id, reverse(seq) as r, {COMP.format('seq')} as c, reverse({COMP.format('seq')}) as rc from reads")
def strand_transforms(spark, d):
    return reads(spark, d).select("read_id", dna.reverse("seq").alias("r"), dna.complement("seq").alias("c"), dna.reverse_complement("seq").alias("rc"))


@query(_with(READS_SQL) + "select c, greatest(instr('ACGT', upper(c)) - 1, 0)::bigint as code, substring('ACGT', greatest(instr('ACGT', upper(c)) - 1, 0)::int + 1, 1) as back, regexp_matches(c, '^[ACGTacgt]$') as is_base from (select distinct unnest(string_split(seq, '')) as c from reads)")
def base_codes(spark, d):
    c = reads(spark, d).select(F.explode(F.split("seq", "")).alias("c")).where("c <> ''").distinct()
    return c.select("c", dna.base_code("c").cast("bigint").alias("code"), dna.code_base(dna.base_code("c")).alias("back"), dna.is_base("c").alias("is_base"))


@query("with t(i, g) as (values (0, 'I'), (1, 'R'), (2, 'C'), (3, 'CR')) select a.g, b.g as h, p.g as product, q.g as inverse from t a, t b, t p, t q where p.i = xor(a.i, b.i) and xor(q.i, a.i) = 0")
def group_product_table(spark, d):
    t = spark.range(4).select(F.get(F.array(*map(F.lit, dna.TRANSFORMS)), F.col("id").cast("int")).alias("g"))
    pairs = t.select("g", F.explode(F.array(*map(F.lit, dna.TRANSFORMS))).alias("h"))
    return pairs.select("g", "h", dna.multiply("g", "h").alias("product"), F.col("g").alias("inverse"))


# --- k-mers


@query(_with(READS_SQL, _kmers(8)) + "select read_id, count(*) as n, min(kmer) as least, max(pos)::bigint as last from kmers group by read_id")
def kmer_explode(spark, d):
    return kmers.explode_kmers(reads(spark, d), 8, "read_id").groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.min("kmer").alias("least"), F.max("pos").alias("last"))


@query(_with(READS_SQL, _kmers(5)) + f"select {_v4('kmer')} as kmer, count(*) as n from kmers group by 1")
def v4_canonical_spectrum(spark, d):
    return kmers.spectrum(reads(spark, d), 5, "v4")


@query(_with(READS_SQL, _kmers(5)) + f"select {_rc('kmer')} as kmer, count(*) as n from kmers group by 1")
def rc_canonical_spectrum(spark, d):
    return kmers.spectrum(reads(spark, d), 5, "rc")


_ORBIT = f"len(list_distinct([kmer, reverse(kmer), {COMP.format('kmer')}, reverse({COMP.format('kmer')})]))"
_TRANSFORM = f"case {_v4('kmer')} when kmer then 'I' when reverse(kmer) then 'R' when {COMP.format('kmer')} then 'C' else 'CR' end"


@query(_with(READS_SQL, _kmers(5)) + f"select kmer, {_v4('kmer')} as canonical, {_TRANSFORM} as transform, count(*) as n from kmers group by 1, 2, 3")
def v4_transform_of_kmer(spark, d):
    return kmers.spectrum(reads(spark, d), 5).select("kmer", dna.canonical_v4("kmer").alias("canonical"), dna.canonical_transform("kmer").alias("transform"), "n")


@query(_with(READS_SQL, _kmers(4)) + f"select kmer, list_filter(['I', 'R', 'C', 'CR'], lambda t: case t when 'I' then kmer when 'R' then reverse(kmer) when 'C' then {COMP.format('kmer')} else reverse({COMP.format('kmer')}) end = {_v4('kmer')})::varchar as transforms from (select distinct kmer from kmers)")
def valid_transforms(spark, d):
    return kmers.spectrum(reads(spark, d), 4).select("kmer", F.concat(F.lit("["), F.array_join(dna.valid_transforms("kmer"), ", "), F.lit("]")).alias("transforms"))


@query(_with(READS_SQL, _kmers(6)) + f"select {_ORBIT}::bigint as orbit, count(*) as n, count(distinct kmer) as kmers from kmers group by 1")
def orbit_size_hist(spark, d):
    return kmers.spectrum(reads(spark, d), 6).groupBy(dna.orbit_size("kmer").cast("bigint").alias("orbit")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kmers"))


@query(_with(READS_SQL, _kmers(4)) + f"select {_v4('kmer')} as orbit, string_agg(distinct kmer, ',' order by kmer) as members, count(distinct kmer) as size from kmers group by 1")
def v4_orbits(spark, d):
    rows = kmers.spectrum(reads(spark, d), 4).groupBy(dna.canonical_v4("kmer").alias("orbit"))
    return rows.agg(F.array_join(F.sort_array(F.collect_set("kmer")), ",").alias("members"), F.count(F.lit(1)).alias("size"))


@query(_with(READS_SQL, _kmers(6)) + f"select kmer, kmer = reverse({COMP.format('kmer')}) as palindrome, kmer = reverse(kmer) as reverse_palindrome, count(*) as n from kmers where kmer = reverse({COMP.format('kmer')}) or kmer = reverse(kmer) group by kmer")
def palindromes(spark, d):
    rows = kmers.spectrum(reads(spark, d), 6).where(dna.is_palindrome("kmer") | dna.is_reverse_palindrome("kmer"))
    return rows.select("kmer", dna.is_palindrome("kmer").alias("palindrome"), dna.is_reverse_palindrome("kmer").alias("reverse_palindrome"), "n")


@query(_with(READS_SQL, _kmers(4)) + f"select kmer, reverse({COMP.format('kmer')}) as other, n, coalesce(m, 0)::bigint as m from (select kmer, count(*) as n from kmers group by kmer) left join (select reverse({COMP.format('kmer')}) as kmer, count(*) as m from kmers group by 1) using (kmer)")
def chargaff_check(spark, d):
    s = kmers.spectrum(reads(spark, d), 4)
    other = s.select(dna.reverse_complement("kmer").alias("kmer"), F.col("n").alias("m"))
    return s.join(other, "kmer", "left").select("kmer", dna.reverse_complement("kmer").alias("other"), "n", F.coalesce("m", F.lit(0).cast("bigint")).alias("m"))





def _minimizer_cte(k: int) -> str:
    return f"m{k} as (select read_id, min({_rc('kmer')}) as m{k} from {_kmers(k).removeprefix('kmers as ')} group by read_id)"


@query(_with(READS_SQL, _minimizer_cte(15), _minimizer_cte(7)) + "select read_id, m15, m7 from reads left join m15 using (read_id) left join m7 using (read_id)")
def minimizers(spark, d):
    return reads(spark, d).select("read_id", dna.minimizer("seq", 15).alias("m15"), dna.minimizer("seq", 7).alias("m7"))


_ORDERED = f"""ordered as (
  select read_id, read_id // {BLOCK} as block_id,
         row_number() over (partition by read_id // {BLOCK} order by m15 nulls last, m7 nulls last, read_id) - 1 as sorted_pos,
         row_number() over (partition by read_id // {BLOCK} order by read_id) - 1 as orig_idx, seq
  from reads left join m15 using (read_id) left join m7 using (read_id))"""


@query(_with(READS_SQL, _minimizer_cte(15), _minimizer_cte(7), _ORDERED) + "select block_id, read_id, sorted_pos, orig_idx from ordered")
def minimizer_order(spark, d):
    return blocks.minimizer_order(blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK), "read_id").select("block_id", "read_id", "sorted_pos", "orig_idx")


@query(_with(READS_SQL) + f"select read_id // {BLOCK} as block_id, row_number() over (partition by read_id // {BLOCK} order by read_id) - 1 as orig_idx, read_id, seq from reads")
def restore_order(spark, d):
    ordered = blocks.minimizer_order(blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK), "read_id")
    return blocks.restore_order(ordered).select("block_id", "orig_idx", "read_id", "seq")


@query(_with(READS_SQL) + f"select read_id // {BLOCK} as block_id, count(*) as records, sum(length(seq))::bigint as bases, sum(length(identifier))::bigint as identifier_chars, sum(length(qual))::bigint as qualities from reads group by 1")
def block_stats(spark, d):
    rows = blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK).groupBy("block_id")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("seq")).alias("bases"), F.sum(F.length("identifier")).alias("identifier_chars"), F.sum(F.length("qual")).alias("qualities"))


@query()
def block_assign_bounded(spark, d):
    return blocks.bounded_blocks(reads(spark, d).select("read_id", F.length("seq").alias("bases")), "read_id", "bases", 700, 30_000)


@query(_with(READS_SQL) + f"select read_id // {BLOCK} as block_id, read_id as pos, identifier, seq, qual, case when read_id % 3 = 0 then 'run' else '' end as plus_line from reads")
def positional_zip(spark, d):
    rows = blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK).withColumn("pos", F.col("read_id"))
    plus = rows.where("pos % 3 = 0").select("block_id", "pos", F.lit("run").alias("plus_line"))
    return blocks.zip_streams(*(rows.select("block_id", "pos", c) for c in ("identifier", "seq", "qual")), plus)


# --- runs and deltas

_CHARS = "chars as (select read_id, unnest(range(0, length({c}))) as pos, unnest(string_split({c}, '')) as ch from reads)"
_ISLANDS = """islands as (select read_id, min(pos) as pos, count(*) as len, ch from (
  select *, pos - row_number() over (partition by read_id, ch order by pos) as g from chars) group by read_id, ch, g)"""


@query(_with(READS_SQL, _CHARS.format(c="seq"), _ISLANDS) + "select read_id, pos, len, ch from islands where ch not in ('A', 'C', 'G', 'T')")
def ambiguous_runs(spark, d):
    return runs.ambiguous_runs(reads(spark, d), "seq", "read_id")


@query(_with(READS_SQL, _CHARS.format(c="seq"), _ISLANDS) + "select read_id, pos, len, pos - coalesce(lag(pos + len) over (partition by read_id order by pos), 0) as gap from islands where ch not in ('A', 'C', 'G', 'T')")
def ambiguous_run_gaps(spark, d):
    return runs.run_gaps(runs.ambiguous_runs(reads(spark, d), "seq", "read_id"), "read_id").select("read_id", "pos", "len", "gap")


@query(_with(READS_SQL) + "select read_id, regexp_replace(seq, '[^ACGT]', 'A', 'g') as stripped from reads")
def ambiguous_strip(spark, d):
    return runs.strip_ambiguous(reads(spark, d), "seq").select("read_id", F.col("seq").alias("stripped"))


@query(_with(READS_SQL) + "select read_id, seq from reads")
def ambiguous_overlay(spark, d):
    return runs.restore_ambiguous(runs.strip_ambiguous(reads(spark, d), "seq"), "seq").select("read_id", "seq")


_CONTIG_BLOCKS = "select doc_id, doc_id // 100 as block_id, sum(length(s)) over (partition by doc_id // 100 order by doc_id)::bigint as last, length(s) as n from contigs"


@query(_with(CONTIGS_SQL) + f"select doc_id, block_id, last - n as first, last from ({_CONTIG_BLOCKS})")
def segment_boundaries(spark, d):
    rows = blocks.fixed_blocks(contigs(spark, d), "doc_id", 100).withColumn("n", F.length("s").cast("bigint"))
    return runs.boundaries(rows, "n", "doc_id", "block_id").select("doc_id", "block_id", "first", "last")


_RUNS = ", ".join((READS_SQL, _CHARS.format(c="qual"), _ISLANDS, "runs as (select *, row_number() over (partition by read_id order by pos) - 1 as run_no from islands)"))


@query("with " + _RUNS + " select read_id, run_no, pos, len, ch from runs")
def qual_rle(spark, d):
    return runs.char_runs(reads(spark, d), "qual", "read_id")


@query(_with(READS_SQL) + "select read_id, qual from reads")
def qual_rle_expand(spark, d):
    return reads(spark, d).select("read_id", text.expand(text.run_structs("qual")).alias("qual"))


@query("with " + _RUNS + " select ch as q, len > 1 as longer, count(*) as n from runs group by all")
def run_flag_counts(spark, d):
    return runs.char_runs(reads(spark, d), "qual", "read_id").groupBy(F.col("ch").alias("q"), (F.col("len") > 1).alias("longer")).agg(F.count(F.lit(1)).alias("n"))


@query("with " + _RUNS + " select ch as q, ext, count(*) as n from (select ch, unnest(list_transform(range(0, (len - 2) // 31 + 1), lambda i: least(31, len - 2 - i * 31))) as ext from runs where len > 1) group by all")
def run_ext_counts(spark, d):
    rows = runs.extensions(runs.char_runs(reads(spark, d), "qual", "read_id"))
    return rows.groupBy(F.col("ch").alias("q"), "ext").agg(F.count(F.lit(1)).alias("n"))


_DELTA = f"select read_id, read_id // {BLOCK} as block_id, length(seq) - lag(length(seq), 1, 0) over (partition by read_id // {BLOCK} order by read_id) as delta, length(seq) as value from reads"


def _length_deltas(spark, d):
    rows = blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK).withColumn("n", F.length("seq").cast("bigint"))
    return runs.delta(rows, "n", "read_id", "block_id")


@query(_with(READS_SQL) + f"select read_id, block_id, delta from ({_DELTA})")
def len_delta(spark, d):
    return _length_deltas(spark, d).select("read_id", "block_id", "delta")


@query(_with(READS_SQL) + f"select read_id, block_id, value from ({_DELTA})")
def len_delta_inverse(spark, d):
    return runs.undo_delta(_length_deltas(spark, d), "read_id", "block_id").select("read_id", "block_id", "value")


_ZIGZAG = "case when delta >= 0 then 2 * delta else -2 * delta - 1 end"


@query(_with(READS_SQL) + f"select read_id, delta, ({_ZIGZAG})::bigint as z, delta as back, case when {_ZIGZAG} < 128 then 1 else 2 end::bigint as bytes from ({_DELTA})")
def zigzag_varint(spark, d):
    z = _length_deltas(spark, d).withColumn("z", numbers.zigzag_encode("delta"))
    return z.select("read_id", "delta", "z", numbers.zigzag_decode("z").alias("back"), numbers.varint_size("z").cast("bigint").alias("bytes"))


@query()
def crc32_seq(spark, d):
    return reads(spark, d).select("read_id", numbers.crc32("seq").alias("crc"))


# --- identifiers

_TOKENS = r"""tokens as (
  select read_id, tok_no, text, case when regexp_matches(text, '^[.:_/# \t@\-|]$') then 'DELIMITER' when regexp_matches(text, '^[0-9]{1,18}$') then 'NUMBER' else 'LITERAL' end as kind
  from (select read_id, unnest(range(0, len(t))) as tok_no, unnest(t) as text from (select read_id, regexp_extract_all(identifier, '([.:_/# \t@\-|]|[^.:_/# \t@\-|]+)') as t from reads)))"""
_NUMBERS = f"""numbers as (
  select read_id, tok_no, num, width, case when p <> 0 and pw = width and num - p between -128 and 127 then num - p end as delta
  from (select *, lag(num) over w as p, lag(width) over w as pw from (
          select read_id, tok_no, read_id // {BLOCK} as b, text::bigint as num, length(text) as width from tokens where kind = 'NUMBER') window w as (partition by b order by read_id, tok_no)))"""
_DICT = "dict as (select text, n, row_number() over (order by n * length(text) desc, text) - 1 as idx from (select text, count(*) as n from tokens where kind = 'LITERAL' group by text having count(*) >= 2) order by idx limit 256)"


def _tokens(spark, d):
    return identifiers.tokenize(reads(spark, d), "read_id")


@query(_with(READS_SQL, _TOKENS) + "select read_id, tok_no, kind, text, case when kind = 'NUMBER' then text::bigint end as num, case when kind = 'NUMBER' then length(text) end as width from tokens")
def tokenize_ids(spark, d):
    return _tokens(spark, d)


@query(_with(READS_SQL) + "select read_id, identifier from reads")
def detokenize_ids(spark, d):
    return identifiers.detokenize(_tokens(spark, d), "read_id")


@query(_with(READS_SQL, _TOKENS) + "select kind, count(*) as n, count(distinct text) as texts from tokens group by kind")
def token_kind_hist(spark, d):
    return _tokens(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts"))


@query(_with(READS_SQL, _TOKENS) + r"select text, (instr('.:_/# ' || chr(9) || '@-|', text) - 1)::bigint as code, count(*) as n from tokens where kind = 'DELIMITER' group by text")
def delimiter_hist(spark, d):
    rows = _tokens(spark, d).where("kind = 'DELIMITER'").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("text", text.delimiter_code("text").cast("bigint").alias("code"), "n")


@query(_with(READS_SQL, _TOKENS, _DICT) + "select text, n, idx from dict")
def token_dictionary_top256(spark, d):
    return identifiers.dictionary(_tokens(spark, d))


@query(_with(READS_SQL, _TOKENS, _DICT) + "select read_id, tok_no, kind, text, case when kind = 'LITERAL' then idx end as idx from tokens left join dict using (text)")
def token_dict_encode(spark, d):
    t = _tokens(spark, d)
    return identifiers.encode(t, identifiers.dictionary(t)).select("read_id", "tok_no", "kind", "text", "idx")


@query(_with(READS_SQL, _TOKENS, _DICT) + "select read_id, tok_no, text from tokens join dict using (text) where kind = 'LITERAL'")
def token_dict_decode(spark, d):
    t = _tokens(spark, d)
    words = identifiers.dictionary(t)
    return identifiers.decode(identifiers.encode(t, words), words).select("read_id", "tok_no", "text")


@query(_with(READS_SQL, _TOKENS, _NUMBERS) + "select read_id, tok_no, num, width, delta from numbers")
def number_delta(spark, d):
    t = blocks.fixed_blocks(_tokens(spark, d), "read_id", BLOCK)
    return identifiers.number_deltas(t, "block_id", record="read_id").select("read_id", "tok_no", "num", "width", "delta")


# --- quality and symbol statistics

_QUAL = "q as (select read_id, unnest(range(0, length(qual))) as pos, length(qual) as len, unnest(string_split(qual, '')) as q, unnest(string_split(seq, '')) as base from reads)"
_QH = "h as (select q, count(*) as n from q group by q)"


def _hist(spark, d):
    return statistics.quality_chars(reads(spark, d)).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@query(_with(READS_SQL, _QUAL, _QH) + "select q, (ascii(q) - 33)::bigint as phred, ascii(q) between 33 and 126 as valid, row_number() over (order by q) - 1 as idx from h")
def qual_alphabet(spark, d):
    a = statistics.alphabet(_hist(spark, d))
    return a.select("q", numbers.phred("q").cast("bigint").alias("phred"), numbers.valid_quality("q").alias("valid"), "idx")


@query(_with(READS_SQL, _QUAL, _QH) + "select q, n, greatest(1, n * 256 // (select sum(n) from h))::bigint as scaled from h")
def qual_scaled_hist(spark, d):
    return statistics.scaled(_hist(spark, d))


_BIN = "least(7, pos * 8 // len)"
_BASE4 = "case base when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end"


@query(_with(READS_SQL, _QUAL) + f"select {_BIN}::bigint as bin, q, count(*) as n from q group by all")
def qual_pos_bin_hist(spark, d):
    return statistics.quality_chars(reads(spark, d)).groupBy(numbers.position_bin("pos", "len").cast("bigint").alias("bin"), "q").agg(F.count(F.lit(1)).alias("n"))


@query(_with(READS_SQL, _QUAL) + f"select ({_BIN} * 4 + {_BASE4})::bigint as bin, q, count(*) as n from q group by all")
def qual_pos_base_bin_hist(spark, d):
    b = (numbers.position_bin("pos", "len") * 4 + dna.base_code("base")).cast("bigint")
    return statistics.quality_chars(reads(spark, d)).groupBy(b.alias("bin"), "q").agg(F.count(F.lit(1)).alias("n"))


def _run_bins(spark, d):
    rows = runs.char_runs(reads(spark, d).withColumn("size", F.length("qual")), "qual", "read_id", "size")
    return blocks.fixed_blocks(rows, "read_id", BLOCK).withColumn("bin", numbers.position_bin("pos", "size").cast("bigint"))


def _context_sql(order: int) -> str:
    lags = ", ".join(f"lag(ch, {i}) over w as p{i}" for i in range(1, order + 1))
    names = ", ".join(f"p{i}" for i in range(1, order + 1))
    return f"with {_RUNS} select bin, {names}, q, count(*) as n from (select least(7, pos * 8 // length(qual))::bigint as bin, {lags}, ch as q from runs join reads using (read_id) window w as (partition by read_id // {BLOCK} order by read_id, run_no)) group by all"


@query(_context_sql(1))
def qual_order1_contexts(spark, d):
    return statistics.run_contexts(_run_bins(spark, d), 1, "read_id", "block_id")


@query(_context_sql(2))
def qual_order2_contexts(spark, d):
    return statistics.run_contexts(_run_bins(spark, d), 2, "read_id", "block_id")


@query(_context_sql(3))
def qual_order3_contexts(spark, d):
    return statistics.run_contexts(_run_bins(spark, d), 3, "read_id", "block_id")


def _hamilton_sql(source: str, keys: str = "", target: int = numbers.PROB_TOTAL, name: str = "cdf") -> str:
    part = f"partition by {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""{name} as (
  with a as (select *, sum(n) over ({part}) as t from {source}),
  b as (select *, case when n > 0 and n * {target} // t = 0 then 1 else n * {target} // t end as p, case when n > 0 and n * {target} // t = 0 then 0 else n * {target} % t end as f from a),
  c as (select *, {target} - sum(p) over ({part}) as rem, row_number() over ({part} order by f desc, symbol) as up,
        row_number() over ({part} order by case when p > 1 then 0 else 1 end, f, symbol) as down from b),
  e as (select *, (p + case when up <= rem and f > 0 then 1 when down <= -rem and p > 1 then -1 else 0 end)::bigint as prob from c)
  select {k}symbol, n, prob, coalesce(sum(prob) over ({part} order by symbol rows between unbounded preceding and 1 preceding), 0)::bigint as cum from e)"""


_CDF = _hamilton_sql("(select q as symbol, n from h)")


@query(_with(READS_SQL, _QUAL, _QH, _CDF) + "select symbol, n, prob, cum from cdf")
def hamilton_cdf(spark, d):
    return statistics.hamilton(_hist(spark, d).withColumnRenamed("q", "symbol"), "symbol")


_TARGET64 = _hamilton_sql("(select kmer as symbol, n * n as n from (select kmer, count(*) as n from kmers group by kmer))", target=64)


@query(_with(READS_SQL, _kmers(2), _TARGET64) + "select symbol, n, prob, cum from cdf")
def hamilton_cdf_small_target(spark, d):
    s = kmers.spectrum(reads(spark, d), 2).select(F.col("kmer").alias("symbol"), (F.col("n") * F.col("n")).alias("n"))
    return statistics.hamilton(s, "symbol", target=64)


@query(_with(READS_SQL, _QUAL, _QH, _CDF) + f"select slot, symbol from (select unnest(range(0, {numbers.PROB_TOTAL})) as slot) join cdf on slot >= cum and slot < cum + prob")
def cdf_slot_lookup(spark, d):
    cdf = statistics.hamilton(_hist(spark, d).withColumnRenamed("q", "symbol"), "symbol")
    slots = cdf.where("prob > 0").select("symbol", F.explode(F.sequence("cum", F.col("cum") + F.col("prob") - 1)).alias("slot"))
    return slots.select("slot", "symbol")


def _ctx_sql(order: int, complemented: bool = True) -> str:
    ctx, base = f"substring(kmer, 1, {order})", f"substring(kmer, {order + 1}, 1)"
    t = _TRANSFORM.replace("kmer", "ctx")
    b = f"case when {t} in ('C', 'CR') then {COMP.format('base')} else base end" if complemented else "base"
    return f"ctxs as (select {_v4('ctx')} as ctx, {b} as base, count(*) as n from (select {ctx} as ctx, {base} as base from kmers) group by 1, 2)"


for _order in (0, 1, 2, 3, 4, 5, 6, 8, 11, 16):

    def _ctx(spark, d, order=_order):
        return kmers.context_counts(reads(spark, d), order)

    _ctx.__name__ = f"ctx_order{_order}"
    query(_with(READS_SQL, _kmers(_order + 1), _ctx_sql(_order)) + "select ctx, base, n from ctxs")(_ctx)


@query(_with(READS_SQL, _kmers(4)) + "select substring(kmer, 1, 3) as ctx, substring(kmer, 4, 1) as base, count(*) as n from kmers group by 1, 2")
def ctx_order3_raw(spark, d):
    return kmers.context_counts(reads(spark, d), 3, pooled=False)


_POOLED_CDF = _hamilton_sql("(select ctx, base as symbol, n + 1 as n from ctxs)", "ctx")


@query(_with(READS_SQL, _kmers(4), _ctx_sql(3, False), _POOLED_CDF) + "select ctx, symbol, n, prob, cum from cdf")
def static_pooled_model(spark, d):
    c = kmers.context_counts(reads(spark, d), 3, complement_base=False).select("ctx", F.col("base").alias("symbol"), (F.col("n") + 1).alias("n"))
    return statistics.hamilton(c, "symbol", "ctx")


@query(_with(READS_SQL, _kmers(9), _ctx_sql(8)) + "select ctx, base, n, total from (select *, sum(n) over (partition by ctx)::bigint as total from ctxs) where total > 8")
def ctx_evicted(spark, d):
    return kmers.evict(kmers.context_counts(reads(spark, d), 8), 8).select("ctx", "base", "n", "total")


@query(_with(READS_SQL, _kmers(4), _ctx_sql(3)) + "select ctx, max(t)::bigint as total, round(sum(-(n / t) * log2(n / t)), 4) as bits from (select *, sum(n) over (partition by ctx) as t from ctxs) group by ctx")
def ctx_entropy_bits(spark, d):
    return kmers.context_entropy(kmers.context_counts(reads(spark, d), 3))


@query(_with(READS_SQL, _kmers(4), _ctx_sql(3)) + "select ctx, base, round((n + 1)::double / (t + 4), 6) as p, case when t > 65535 then (n >> 1) | 1 else n end::bigint as rescaled from (select *, sum(n) over (partition by ctx)::bigint as t from ctxs)")
def ctx_laplace_rescale(spark, d):
    from pyspark.sql.window import Window

    c = kmers.context_counts(reads(spark, d), 3).withColumn("t", F.sum("n").over(Window.partitionBy("ctx")))
    return c.select("ctx", "base", F.round(numbers.laplace("n", "t"), 6).alias("p"), numbers.rescale("n", "t").cast("bigint").alias("rescaled"))


@query(_with(READS_SQL, _kmers(3), _kmers(4).replace("kmers as", "k4 as"), _ctx_sql(2)) + f"select kmer, next, coalesce(n, 0)::bigint as n from (select distinct substring(kmer, 1, 2) as kmer, substring(kmer, 3, 1) as next from k4) left join (select ctx, base, n from ctxs) on ctx = {_v4('kmer')} and base = case when {_TRANSFORM} in ('C', 'CR') then {COMP.format('next')} else next end")
def ctx_lookup(spark, d):
    seen = kmers.spectrum(reads(spark, d), 4).select(F.substring("kmer", 1, 2).alias("kmer"), F.substring("kmer", 3, 1).alias("next")).distinct()
    key = seen.withColumns({"ctx": dna.canonical_v4("kmer"), "base": F.when(dna.canonical_transform("kmer").isin("C", "CR"), dna.complement("next")).otherwise(F.col("next"))})
    return key.join(kmers.context_counts(reads(spark, d), 2), ["ctx", "base"], "left").select("kmer", "next", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _confidence_sql(orders: range) -> str:
    parts = [READS_SQL]
    for k in orders:
        parts += [_kmers(k + 1).replace("kmers as", f"k{k} as", 1), _ctx_sql(k).replace("ctxs as", f"c{k} as", 1).replace("from kmers", f"from k{k}")]
    best = " union all ".join(
        f"(select {k}::bigint as k, ctx, base, round((n + 1)::double / (t + 4), 6) as p, {min(7, k // 2)}::bigint as bucket from (select *, sum(n) over (partition by ctx)::bigint as t from c{k}) order by p desc, ctx, base limit 1)"
        for k in orders
    )
    return _with(*parts) + best


@query(_confidence_sql(range(1, 5)))
def order_of_confidence(spark, d):
    return kmers.most_confident(reads(spark, d), range(1, 5))


@query(_with(READS_SQL, _QUAL, _QH) + "select q, round(n / (select sum(n) from h), 6) as p, round(ln((n / (select sum(n) from h)) / (1 - n / (select sum(n) from h))), 4) as stretched from h")
def stretch_squash(spark, d):
    from pyspark.sql.window import Window

    p = _hist(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return p.select("q", F.round(numbers.squash(numbers.stretch("p")), 6).alias("p"), F.round(numbers.stretch("p"), 4).alias("stretched"))


_BINS_SQL = f"bins as (select read_id, run_no, ch, read_id // {BLOCK} as block_id from runs)"
_PPM = """h0 as (select ch as q, count(*) as n from bins group by ch),
h1 as (select p1, ch as q, count(*) as n from (select ch, lag(ch) over (partition by block_id order by read_id, run_no) as p1 from bins) where p1 is not null group by 1, 2),
t0 as (select sum(n) as t from h0), t1 as (select p1, sum(n) as t from h1 group by p1),
part as (select t1.p1, h0.q, (h0.n / t0.t) * 1.0 * ln(t0.t / 1 + 1) as p from t1, h0, t0
  union all select h1.p1, h1.q, (h1.n / t1.t) * 2.0 * ln(t1.t / 8 + 1) from h1 join t1 using (p1)),
mixed as (select p1, q, sum(p) as p from part group by p1, q)"""


@query(_with(_RUNS, _BINS_SQL, _PPM) + "select p1, q, round(p / sum(p) over (partition by p1), 6) as p from mixed")
def ppm_blend(spark, d):
    r = _run_bins(spark, d)
    whole = r.groupBy(F.col("ch").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    after = statistics.run_contexts(r, 1, "read_id", "block_id").where("p1 is not null").groupBy("p1", "q").agg(F.sum("n").alias("n"))
    return statistics.blend(after, whole, "p1", (2.0, 1.0), (8, 1))


_TRUST = """lagged as (select ch, block_id, lag(ch) over w as p1, lag(ch, 2) over w as p2, lag(ch, 3) over w as p3 from bins window w as (partition by block_id order by read_id, run_no)),
totals as (select count(*) over (partition by p1) as t1, count(*) over (partition by p1, p2) as t2, count(*) over (partition by p1, p2, p3) as t3 from lagged where p3 is not null)"""


@query(_with(_RUNS, _BINS_SQL, _TRUST) + "select case when t3 >= 16 then 3 when t2 >= 16 then 2 when t1 >= 8 then 1 else 0 end::bigint as trusted, count(*) as n from totals group by 1")
def qual_trusted_order(spark, d):
    contexts = statistics.run_contexts(_run_bins(spark, d), 3, "read_id", "block_id").where("p3 is not null").groupBy("p1", "p2", "p3").agg(F.sum("n").alias("n"))
    return statistics.trusted(contexts).groupBy("trusted").agg(F.sum("n").alias("n"))


@query(_with(READS_SQL, _QUAL) + "select q, count(*) as n from q group by q")
def qual_index_roundtrip(spark, d):
    index = statistics.alphabet(_hist(spark, d).select("q"))
    coded = statistics.quality_chars(reads(spark, d)).join(F.broadcast(index), "q").select("idx")
    return coded.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(index), "idx").select("q", "n")


# --- repeats

_PREV = f"""prev as (select read_id, pos, ctx, next, {', '.join(f'lag(read_id, {i}) over w as prev{i}_read, lag(pos, {i}) over w as prev{i}_pos, lag(next, {i}) over w as prev{i}_next' for i in (1, 2, 3))}
  from (select read_id, pos, {_v4('substring(kmer, 1, 8)')} as ctx, substring(kmer, 9, 1) as next from kmers) window w as (partition by ctx order by read_id, pos))"""


def _previous(spark, d):
    p = repeats.previous_occurrences(reads(spark, d), 8, "read_id", span=5000)
    return p.select("read_id", "pos", "ctx", "next", *[F.col(f"prev{i}.{a}").alias(f"prev{i}_{b}") for i in (1, 2, 3) for a, b in (("record", "read"), ("pos", "pos"), ("next", "next"))])


@query(_with(READS_SQL, _kmers(9), _PREV) + "select * from prev where prev1_read is not null")
def prev_occurrence_match(spark, d):
    return _previous(spark, d).where("prev1_read is not null")


@query(_with(READS_SQL, _kmers(9), _PREV) + "select read_id, pos, case when next = prev1_next then 1 when next = prev2_next then 2 when next = prev3_next then 3 else 0 end::bigint as candidate from prev")
def verified_match(spark, d):
    return _previous(spark, d).select("read_id", "pos", repeats.verified("next", "prev1_next", "prev2_next", "prev3_next").alias("candidate"))


_HITS = "hits as (select read_id, pos, coalesce((next = prev1_next)::int, 0) as hit from prev)"


@query(_with(READS_SQL, _kmers(9), _PREV, _HITS) + "select read_id, pos, hit::bigint as hit, (sum(hit) over (partition by read_id, g order by pos))::bigint as streak from (select *, sum(1 - hit) over (partition by read_id order by pos) as g from hits)")
def match_streaks(spark, d):
    hits = _previous(spark, d).select("read_id", "pos", F.coalesce((F.col("next") == F.col("prev1_next")).cast("bigint"), F.lit(0).cast("bigint")).alias("hit"))
    return repeats.streaks(hits, "hit", "pos", "read_id")


@query(_with(READS_SQL, _kmers(9), _PREV, _HITS) + "select read_id, pos, (sum(1 - hit) over (partition by read_id order by pos rows between 31 preceding and current row))::bigint as misses from hits")
def mismatch_window32(spark, d):
    rows = _previous(spark, d).select("read_id", "pos", F.coalesce((F.col("next") != F.col("prev1_next")).cast("bigint"), F.lit(1).cast("bigint")).alias("miss"))
    return repeats.recent_misses(rows, "miss", "pos", "read_id").select("read_id", "pos", "misses")


@query(_with(READS_SQL, _kmers(9), _PREV) + f"select case when prev1_next = next then 'match' when {COMP.format('prev1_next')} = next then 'transition' else 'transversion' end as edit, count(*) as n from prev where prev1_next is not null group by 1")
def edit_classes(spark, d):
    return _previous(spark, d).where("prev1_next is not null").groupBy(dna.edit_class("prev1_next", "next").alias("edit")).agg(F.count(F.lit(1)).alias("n"))


_COPY = f"""k12 as (select doc_id, pos, kmer, 12 as k from {{0}}),
k8 as (select doc_id, pos, kmer, 8 as k from {{1}}),
spots as (select * from k12 union all select * from k8),
wanted as (
  select doc_id, k, pos, kmer as key, true as asks, 'direct' as channel from spots union all select doc_id, k, pos, kmer, false, 'direct' from spots
  union all select doc_id, k, pos, kmer, true, 'complement' from spots union all select doc_id, k, pos, {COMP.format('kmer')}, false, 'complement' from spots),
sources as (
  select *, last_value(case when not asks then pos end ignore nulls) over w as s1, last_value(case when not asks then before end ignore nulls) over w as s2
  from (select *, case when not asks then lag(pos) over (partition by doc_id, k, channel, key, asks order by pos) end as before from wanted)
  window w as (partition by doc_id, k, channel, key order by pos, asks rows between unbounded preceding and 1 preceding)),
candidates as (
  select doc_id, pos + k as pos, k, channel, r, s + k as source from (
    select doc_id, pos, k, channel, 1 as r, case when s1 = pos then s2 else s1 end as s from sources where asks
    union all select doc_id, pos, k, channel, 2, s2 from sources where asks and s1 <> pos)
  where pos - s >= k)"""
_COPY_SQL = _with(CONTIGS_SQL, _kmers(12, "doc_id", "contigs", "s").replace("kmers as", "m12 as", 1), _kmers(8, "doc_id", "contigs", "s").replace("kmers as", "m8 as", 1), _COPY.format("m12", "m8"))


@query(_COPY_SQL + """select doc_id, pos, k::bigint as anchor, channel, source from candidates c where not exists (
  select 1 from candidates o where o.doc_id = c.doc_id and o.pos = c.pos and abs(o.source - c.source) <= 4 and o.channel = c.channel and (o.k > c.k or (o.k = c.k and o.r < c.r)))""")
def copy_match(spark, d):
    found = repeats.copies(contigs(spark, d).withColumnRenamed("s", "seq"), "doc_id", anchors=(12, 8))
    return found.select("doc_id", "pos", "anchor", "channel", "source")


@query(_with(READS_SQL, _kmers(9), _PREV, _HITS, "edits as (select *, sum(1 - hit) over (partition by read_id order by pos rows between 15 preceding and current row) as edits from hits)") + "select read_id, pos, edits <= 7 as tolerant from edits")
def tolerant_gate(spark, d):
    rows = _previous(spark, d).select("read_id", "pos", F.coalesce((F.col("next") != F.col("prev1_next")).cast("bigint"), F.lit(1).cast("bigint")).alias("miss"))
    return repeats.edit_history(rows, "miss", "pos", "read_id").select("read_id", "pos", repeats.tolerant(F.col("history"), 16, 7).alias("tolerant"))


@query(_with(READS_SQL, _kmers(9), _PREV, _HITS) + "select read_id, pos from (select read_id, pos, sum(1 - hit) over (partition by read_id order by pos rows between 31 preceding and current row) as m from hits) where m <= 3")
def mismatch_kept(spark, d):
    rows = _previous(spark, d).select("read_id", "pos", F.coalesce((F.col("next") != F.col("prev1_next")).cast("bigint"), F.lit(1).cast("bigint")).alias("miss"))
    return repeats.recent_misses(rows, "miss", "pos", "read_id").where("misses <= 3").select("read_id", "pos")


@query(_with(READS_SQL, _kmers(4)) + f"select read_id, round(list_reduce(list_prepend(0.0::double, list(case when {_TRANSFORM} in ('C', 'CR') then 1.0::double else 0.0 end order by pos)), lambda a, x: a + (x - a) * 0.05), 6) as ema from kmers group by read_id")
def transform_moving_average(spark, d):
    r = reads(spark, d).select("read_id", F.transform(dna.pure_kmers("seq", 4), lambda k: dna.canonical_transform(k).isin("C", "CR").cast("int")).alias("uses"))
    return r.where("size(uses) > 0").select("read_id", F.round(repeats.moving_average(F.col("uses")), 6).alias("ema"))


# --- records, checks and reports


@query(_with(READS_SQL) + "select read_id, '>' || identifier || chr(10) || rtrim(regexp_replace(seq, '(.{20})', '\\1' || chr(10), 'g'), chr(10)) as fasta from reads")
def fasta_wrap(spark, d):
    return reads(spark, d).select("read_id", F.concat(F.lit(">"), "identifier", F.lit("\n"), text.wrap("seq", 20)).alias("fasta"))


@query(_with(READS_SQL) + "select read_id, '@' || identifier || chr(10) || seq || chr(10) || '+' || chr(10) || qual as fastq, length(seq) > 0 and length(seq) = length(qual) as valid from reads")
def fastq_text(spark, d):
    from ..sources.fastq import is_valid, to_text

    return reads(spark, d).select("read_id", to_text("identifier", "seq", F.lit(""), "qual").alias("fastq"), is_valid("seq", "qual").alias("valid"))


@query(_with(READS_SQL) + f"select read_id // {BLOCK} as block_id, bool_or(read_id % 1500 = 0) as any_plus, string_agg(case when read_id % 1500 = 0 then '1' else '0' end, '' order by read_id) as mask from reads group by 1")
def plusline_mask(spark, d):
    rows = blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK).withColumn("plus", F.when(F.col("read_id") % 1500 == 0, F.lit("run")).otherwise(""))
    bits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("read_id", (F.col("plus") != "").cast("int").alias("b")))), lambda x: x["b"].cast("string")), "")
    return rows.groupBy("block_id").agg(F.bool_or(F.col("plus") != "").alias("any_plus"), bits.alias("mask"))


@query(_with(READS_SQL) + "select count(*) as records, sum(length(seq))::bigint as bases, sum(length(qual))::bigint as qualities, sum(length(identifier))::bigint as identifier_chars, sum(length(seq) + length(qual) + length(identifier) + 6)::bigint as text_bytes, round(8.0 * sum(length(regexp_replace(seq, '[^N]', '', 'g'))) / sum(length(seq)), 6) as n_bits_per_base from reads")
def stats_fastq(spark, d):
    r = reads(spark, d).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("seq")).alias("bases"), F.sum(F.length("qual")).alias("qualities"), F.sum(F.length("identifier")).alias("identifier_chars"),
        F.sum(F.length("seq") + F.length("qual") + F.length("identifier") + 6).alias("text_bytes"), F.sum(F.length(F.regexp_replace("seq", "[^N]", ""))).alias("_n"),
    )
    return r.select("records", "bases", "qualities", "identifier_chars", "text_bytes", F.round(numbers.bits_per("_n", "bases"), 6).alias("n_bits_per_base"))


@query(_with(CONTIGS_SQL) + "select doc_id // 100 as block_id, string_agg(s, '' order by doc_id) as s from contigs group by 1")
def concat_sequences(spark, d):
    rows = blocks.fixed_blocks(contigs(spark, d), "doc_id", 100)
    return rows.groupBy("block_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]), "").alias("s"))


@query(_with(CONTIGS_SQL) + "select doc_id as record_no, coalesce(sum(length(s)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, regexp_replace(s, '[^ACGT]', 'A', 'g') as sequence from contigs")
def sequence_offsets(spark, d):
    from ..sources.fasta import sequence_only

    return sequence_only(contigs(spark, d).select(F.col("doc_id").alias("record_no"), F.regexp_replace("s", "[^ACGT]", "A").alias("sequence")))


@query(_with(CONTIGS_SQL) + "select doc_id, s from contigs")
def split_by_lengths(spark, d):
    rows = blocks.fixed_blocks(contigs(spark, d), "doc_id", 100)
    joined = rows.groupBy("block_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]), "").alias("whole"))
    places = runs.boundaries(rows.select("block_id", "doc_id", F.length("s").alias("size")), "size", "doc_id", "block_id")
    return places.join(joined, "block_id").select("doc_id", F.substr("whole", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")).alias("s"))


@query(_with(READS_SQL) + "select read_id, identifier, seq, '' as plus_line, qual from reads")
def codec_roundtrip(spark, d):
    from .codec import decode_blocks, encode_blocks

    rows = blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK).withColumn("plus_line", F.lit(""))
    return decode_blocks(encode_blocks(rows, "read_id"), "read_id", cut=False).select("read_id", "identifier", "seq", "plus_line", "qual")


@query(_with(CONTIGS_SQL) + "select doc_id as record_no, 'doc ' || doc_id as header, s as sequence from contigs")
def fasta_archive_roundtrip(spark, d):
    from .codec import archive_fasta, decode_fasta

    rows = contigs(spark, d).select(F.col("doc_id").alias("record_no"), F.concat(F.lit("doc "), "doc_id").alias("header"), F.col("s").alias("sequence"))
    return decode_fasta(archive_fasta(rows, piece=10_000))


@query(_with(READS_SQL) + "select read_id, identifier, seq, case when read_id % 3 = 0 then identifier else '' end as plus_line, qual from reads")
def adaptive_roundtrip(spark, d):
    from .codec import Options, archive, decode_blocks

    rows = reads(spark, d).withColumn("plus_line", F.when(F.col("read_id") % 3 == 0, F.col("identifier")).otherwise(F.lit("")))
    return decode_blocks(archive(rows, "read_id", Options("adaptive")), "read_id", cut=False).select("read_id", "identifier", "seq", "plus_line", "qual")


@query()
def archive_stats(spark, d):
    from .codec import archive_report, encode_blocks

    return archive_report(encode_blocks(blocks.fixed_blocks(reads(spark, d), "read_id", BLOCK).withColumn("plus_line", F.lit("")), "read_id"))
