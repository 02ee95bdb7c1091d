"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gitstrata.llm import chat, decontamination, html_text, licenses, line_dedup, minhash, mixing, neighbours, periodic, pii, quality, repair, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with numbered as (
  select row_number() over () as row, doc_id, coalesce(doc_id, (-9223372036854775807)::bigint - 1) as id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (
  select row, doc_id, id, unnest(parts) as line, unnest(range(len(parts))) as pos from numbered),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
frequent as (
  select k, max(id) as keeper from keyed where length(k) >= 40 group by k having count(distinct id) >= 5)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines,
       count(*) filter (where f.k is not null and id < keeper)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null or id >= keeper), '')) as kept_sha256
from keyed left join frequent f on keyed.k = f.k
group by row
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    out = quality.apply_rules(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: documents -> doc_id, size, source_size, target, taken
MIX_SQL = r"""
sized as (
  select doc_id, source, md5('mix:' || coalesce(doc_id::varchar, '')) as draw,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from {docs}),
sources as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int] as weight
  from sized group by source),
ordered as (
  select *, 2.0::double * source_size as cap, row_number() over (order by 2.0::double * source_size / weight, source nulls last) as r from sources),
prefix as (
  select *, coalesce(sum(cap) over (order by r rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(weight) over (order by r rows between current row and unbounded following) as open_weight,
         (sum(source_size) over ())::double * 1.5 as total
  from ordered),
first_open as (
  select min_by(capped, r) as capped, min_by(open_weight, r) as open_weight, min(r) as r
  from prefix where (total - capped) * weight / open_weight <= cap),
plan as (
  select source, source_size,
         case when p.r < f.r then cap else (total - f.capped)::double * weight / f.open_weight::double end as target
  from prefix p, first_open f),
extra as (
  select source, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
         target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size as extra
  from plan),
places as (
  select source, draw, sum(size) as size from sized group by source, draw),
upto as (
  select source, draw, size, sum(size) over (partition by source order by draw) - size / 2 as mid from places)
select s.doc_id, s.size, e.source_size::bigint as source_size, e.target::double as target,
       (s.size * (e.whole + (case when e.extra > 0 and u.mid <= e.extra then 1 else 0 end)))::bigint as taken
from sized s join extra e on s.source is not distinct from e.source
join upto u on u.source is not distinct from s.source and u.draw = s.draw
"""
OP4_SQL = "with " + MIX_SQL.format(docs="documents")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known_licenses(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _joined_sql(text: str) -> str:
    out = f"' ' || {text}"
    for parted, one in licenses.PARTED.items():
        out = f"replace({out}, '{parted}', '{one}')"
    return f"ltrim({out}, ' ')"


OP5_SQL = rf"""
with texts as (
  select doc_id, null::varchar as license_id, text, row_number() over () as row from documents
  union all select null, license_id, text, -row_number() over () from (values {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)}) known(license_id, text)),
lines as (
  select row, unnest(string_split(translate(coalesce(text, ''), {_quoted(licenses._FROM)}, {_quoted(licenses._TO)}), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from texts),
spelt as (
  select row, pos, array_to_string(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
    lambda w: coalesce(map {{{", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS.items())}}}[w], w)), ' ') as line
  from lines),
kept as (
  select * from spelt
  where line <> '' and not (regexp_matches(line, '{licenses.COPYRIGHT}') and not regexp_matches(line, '{licenses.RUNNING}'))),
entire as (
  select row, {_joined_sql("string_agg(line, ' ' order by pos)")} as canonical from kept group by row),
known as (
  select digest, min(license_id) as license from (
    select sha256(canonical) as digest, license_id from entire join texts using (row) where row < 0
    union all select * from (values {", ".join(f"('{d}', '{i}')" for i, ds in licenses.DIGESTS for d in ds)}) given(digest, license_id)) every group by digest),
notices as (
  select row, count(*) as n, string_agg(distinct license, ',' order by license) as found
  from kept join known on sha256({_joined_sql("line")}) = digest group by row)
select t.doc_id, len(regexp_extract_all(coalesce(e.canonical, ''), '[^ ]+'))::bigint as n_words, sha256(e.canonical) as digest, k.license,
       coalesce(n.n, 0)::bigint as n_notices, coalesce(n.found, '') as notices
from texts t left join entire e on e.row = t.row left join known k on k.digest = sha256(e.canonical) left join notices n on n.row = t.row
where t.row > 0
"""

SPECIAL = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(SPECIAL).alias("text"))
    out = chat.format_chat(rows.unionByName(extra)).withColumn("_turns", chat.read_back(F.col("formatted")))
    joined = lambda parts: F.array_join(parts, "")
    return out.withColumn("_loss", joined(F.transform(F.filter("segments", lambda s: s.loss), lambda s: chat.unescaped(s.text)))).select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(joined(F.transform("_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP9_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, length(text) + length(regexp_replace(text, '[^\[\]<\\]', '', 'g'))
            + case role when 'system' then 6 + 8 when 'user' then 7 + 9 when 'assistant' then 3 + 5
              else 8 + length(role) + length(regexp_replace(role, '[^\[\]<\\]', '', 'g')) + 9 end as chars,
         coalesce(lag(role) over o, 'start') || '>' || role in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') as moves,
         row_number() over (partition by conv_id order by turn desc nulls first, role desc, text desc) = 1 and role = 'assistant' as ends
  from turns window o as (partition by conv_id order by turn nulls last, role, text))
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars, bool_and(moves) and bool_or(ends) as valid
from marked group by conv_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: one row for each document and benchmark item that it holds."""
    return decontamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    top = runs.withColumn("_top", periodic.strongest(F.col("runs")))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period", F.floor(1000 * F.col("_top.length") / F.col("_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which no row is left after the damage have zeros and the hash of nothing."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, left = repair.repair(repair.damaged(given))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c")
    out = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("_c", key)
    out = out.join(report.withColumn("_c", key).drop("conv_id"), "_c", "left").join(repair.digests(left).select(key, "repaired_sha256"), "_c", "left").drop("_c")
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def _op13_sql() -> str:
    """The lattice row by row: for each grammar state the least (cost, letters, lines), all inserts after each row."""
    add = lambda s, cost, letter, line: f"case when a.{s} is not null then struct_pack(c := (a.{s}.c + {cost})::bigint, a := a.{s}.a || '{letter}', t := a.{s}.t || {line}) end"
    stays, kept = "x.fault not in ('blank', 'duplicate')", "chr(10) || x.role || ':' || x.text"
    extra = "(case when x.fault = 'truncated' then 5 else 0 end)"
    keep = lambda s, letter: f"case when {stays} and left(x.role, 1) = '{letter}' then {add(s, extra, 'K', kept)} end"
    turn = lambda s, role: f"case when {stays} then {add(s, '1 + ' + extra, 'R', f"chr(10) || '{role}:' || x.text")} end"
    gone = lambda s: add(s, 2, "D", "''")
    user = [w for s in ("s0", "s1", "s3") for w in (keep(s, "u"), turn(s, "user"))]
    rows = {"s0": [gone("s0")], "s1": [gone("s1"), keep("s0", "s")], "s2": [gone("s2"), *user], "s3": [gone("s3"), keep("s2", "a"), turn("s2", "assistant")]}
    put = lambda s, role: add(s, 5, "I", f"chr(10) || '{role}:'")
    least = lambda ways: f"list_min([{', '.join(ways)}])"
    pack = lambda states: "struct_pack(role := x.role, text := x.text, fault := x.fault, " + ", ".join(f"{s} := {w}" for s, w in states.items()) + ")"
    same = lambda *states: {s: f"a.{s}" for s in states}
    steps = (
        pack({s: least(w) for s, w in rows.items()}),
        pack(same("s0", "s1", "s3") | {"s2": least(["a.s2", *(put(s, "user") for s in ("s0", "s1", "s3"))])}),
        pack(same("s0", "s1", "s2") | {"s3": least(["a.s3", put("s2", "assistant")])}),
    )
    step = steps[0]
    for then in steps[1:]:  # each step's result is the next one's a
        step = f"list_transform([{step}], lambda a: {then})[1]"
    state, none = "struct(c bigint, a varchar, t varchar)", "null::struct(c bigint, a varchar, t varchar)"
    start = f"struct_pack(role := '', text := '', fault := '', s0 := {{'c': 0, 'a': '', 't': ''}}::{state}, s1 := {none}, s2 := {{'c': 5, 'a': 'I', 't': chr(10) || 'user:'}}::{state}, s3 := {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}::{state})"
    return rf"""
with crc as (select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t from (select unnest(range(256)) as n) x),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 20 as k
  from conversations, crc),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from given where k <> 0),
bare as (select *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b, row_number() over (partition by conv_id, role, text order by turn nulls first) as nth from damaged),
faulty as (select conv_id, turn, role, text, case when b = '' then 'blank' when nth > 1 then 'duplicate' when right(b, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
                  row_number() over (partition by conv_id order by turn nulls first, role, text, nth) as place from bare),
moves as (select *, left(role, 1) as i, lag(left(role, 1)) over (partition by conv_id order by place) as before from faulty),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
         count(*) filter (where place > 1 and before || i not in ('su', 'ua', 'au')) as illegal,
         list(struct_pack(role := role, text := text, fault := fault, s0 := {none}, s1 := {none}, s2 := {none}, s3 := {none}) order by place) as rows
  from moves group by conv_id),
walked as (select *, list_reduce(list_prepend({start}, rows), lambda a, x: {step}) as f from counted),
best as (select *, list_min([f.s0, f.s3]) as w from walked)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(w.c, 0) as cost, coalesce(w.a, '') as audit, sha256(coalesce(substr(w.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join best b on o.conv_id is not distinct from b.conv_id
"""


OP13_SQL = _op13_sql()


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_decontamination, op3_quality_rules, op4_source_mix, op5_license_scan, op6_html_text, op7_pii, op8_toxicity, op9_chat_format, op10_minhash,
        op11_periodic_runs, op12_nearest_neighbours, op13_conversation_repair,
    )
}
SQL = {"op1_line_dedup": OP1_SQL, "op4_source_mix": OP4_SQL, "op5_license_scan": OP5_SQL, "op9_chat_format": OP9_SQL, "op13_conversation_repair": OP13_SQL}
