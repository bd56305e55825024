"""The queries of this subpackage over a data folder, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact, hostrules, langid, lines, mixing, pseudolm, quality, repair, simhash, substrings, toxicity, trie
from .sql import HOST_SQL, REPAIR_SQL, TRIE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


MIX_SQL = """
with sized as (
    select doc_id, source,
           cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) as bigint) as size,
           (cast(('0x' || substr(md5('mix-1' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) + 0.5::double)
               / 4503599627370496.0::double as u
    from documents
), per as (
    select source, cast(sum(size) as bigint) as source_size,
           case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
    from sized group by source
), filled as (
    select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0))::double
              / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level,
           source_size * 1.0::double / weight as ratio
    from per
    window before as (order by source_size * 1.0::double / weight, source asc nulls last rows between unbounded preceding and 1 preceding)
), cut as (
    select level as cut from filled where level * weight <= 3 * source_size order by ratio, level limit 1
), targeted as (
    select source, source_size,
           case when coalesce((select cut from cut) * weight > 3 * source_size, true) then cast(3 * source_size as double)
                else (select cut from cut) * weight end as target
    from filled
), planned as (
    select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as copies from targeted
), wanted as (
    select *, target - copies * source_size as rest_words from planned
), hist as (
    select s.source, s.size, count(*) as n from sized s where s.size > 0 group by all
), factors as (
    select h.source, h.size,
           (w.rest_words - coalesce(sum(h.size * h.n) over (partition by h.source order by h.size desc rows between unbounded preceding and 1 preceding), 0)::double)
           / sum(cast(h.size as double) * h.size * h.n) over (partition by h.source order by h.size desc rows between current row and unbounded following) as factor
    from hist h join wanted w on h.source is not distinct from w.source
), factor as (
    select source, max_by(factor, size) as factor from factors where factor * size <= 1 and factor >= 0 group by source
), chance as (
    select s.*, w.source_size, w.target, w.copies, w.rest_words, least(coalesce(f.factor, 0) * s.size, 1) as p
    from sized s join wanted w on s.source is not distinct from w.source
         left join factor f on s.source is not distinct from f.source
), ranked as (
    select *, case when p >= 1 then 0 when p <= 0 then 1
              else ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) end as rank from chance
), summed as (
    select *, sum(size) over (partition by source order by (p < 1), rank, doc_id, size rows unbounded preceding) as running from ranked
)
select doc_id, size, source_size, target,
       cast(size * (copies + case when running - size / 2.0::double <= rest_words then 1 else 0 end) as bigint) as taken
from summed
"""


@query("op2_mix_sources", MIX_SQL)
def op2(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


EXACT_SQL = """
with normal as (
    select doc_id, regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g') as norm from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept, sha256(norm) as text_sha256
from normal
window w as (partition by norm order by doc_id nulls last)
"""


@query("op9_exact_dedup", EXACT_SQL)
def op9(spark, sf_dir):
    return exact.exact_duplicates(_read(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = """
with doc_words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
    from documents
), item_words as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
    from benchmark
), item_grams as (
    select item_id, least(len(words), 10) as n, unnest(range(1, len(words) - least(len(words), 10) + 2)) as pos, words
    from item_words where len(words) > 0
), windows as (
    select distinct item_id, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') as gram from item_grams
), doc_starts as (
    select doc_id, n, words, unnest(range(1, len(words) - n + 2)) as pos
    from doc_words, (select distinct n from windows) where len(words) >= n
), doc_grams as (
    select doc_id, n, pos, array_to_string(list_slice(words, pos, pos + n - 1), ' ') as gram from doc_starts
), hits as (
    select distinct d.doc_id, d.n, d.pos, w.item_id from doc_grams d join windows w on d.n = w.n and d.gram = w.gram
), hit_words as (
    select doc_id, count(distinct word) as n_hit
    from (select doc_id, unnest(range(pos, pos + n)) as word from hits) group by doc_id
), hit_items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select d.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


@query("op1_decontamination", DECONTAMINATION_SQL)
def op1(spark, sf_dir):
    return decontaminate.decontamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query("op7_simhash")
def op7(spark, sf_dir):
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


SUBSTRING_SQL = """
with doc_words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') as words from documents
), starts as (
    select doc_id, words, unnest(range(1, len(words) - 48)) as pos from doc_words where len(words) >= 50
), grams as (
    select doc_id, pos, array_to_string(list_slice(words, pos, pos + 49), ' ') as gram from starts
), firsts as (
    select gram, min(doc_id) as least from grams group by gram
), gone as (
    select distinct g.doc_id, unnest(range(g.pos, g.pos + 50)) as word from grams g join firsts f on g.gram = f.gram and g.doc_id > f.least
), numbered as (
    select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from doc_words
), kept as (
    select n.doc_id, string_agg(n.word, ' ' order by n.pos) as text, count(*) as n_kept
    from numbered n left join gone g on n.doc_id = g.doc_id and n.pos = g.word where g.word is null group by n.doc_id
)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(len(d.words) - coalesce(k.n_kept, 0) as bigint) as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from doc_words d left join kept k using (doc_id)
"""


@query("op5_substring_dedup", SUBSTRING_SQL)
def op5(spark, sf_dir):
    return substrings.remove_repeated(_read(spark, sf_dir, "documents")).drop("kept_text")


LINE_SQL = """
with doc_lines as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), sizes as (
    select unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384]) as size
), starts as (
    select doc_id, lines, size, unnest(range(1, len(lines) - size + 2)) as pos from doc_lines, sizes where len(lines) >= size
), runs as (
    select doc_id, pos, size, array_to_string(list_slice(lines, pos, pos + size - 1), chr(10)) as run from starts
), copies as (
    select doc_id, pos, size from (
        select doc_id, pos, size, run, row_number() over (partition by size, run order by doc_id nulls last, pos) as place from runs
    ) r where place > 1 and len(regexp_extract_all(run, '[^ \\t-\\r]+')) >= 5
), gone as (
    select distinct doc_id, unnest(range(pos, pos + size)) as pos from copies
), numbered as (
    select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from doc_lines
), kept as (
    select n.doc_id, string_agg(n.line, chr(10) order by n.pos) as text, count(*) as n_kept
    from numbered n left join gone g on n.doc_id = g.doc_id and n.pos = g.pos where g.pos is null group by n.doc_id
)
select d.doc_id, cast(len(d.lines) as bigint) as n_lines, cast(len(d.lines) - coalesce(k.n_kept, 0) as bigint) as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from doc_lines d left join kept k using (doc_id)
"""


@query("op10_line_dedup", LINE_SQL)
def op10(spark, sf_dir):
    return lines.line_report(_read(spark, sf_dir, "documents")).drop("kept_text")


@query("op3_quality")
def op3(spark, sf_dir):
    return quality.quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op8_language_id")
def op8(spark, sf_dir):
    return langid.language_report(_read(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("restored")


@query("op6_pseudo_likelihood")
def op6(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    counts = pseudolm.word_counts(docs)
    model = pseudolm.start(counts)
    encoded = pseudolm.encode(docs, model, counts)
    return pseudolm.score_encoded(encoded, pseudolm.learn(encoded, model), counts)


@query("op11_host_rules", HOST_SQL)
def op11(spark, sf_dir):
    return hostrules.rule_report(_read(spark, sf_dir, "documents"))


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark, sf_dir):
    conversations = _read(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damage(conversations), conversations)


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark, sf_dir):
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))
