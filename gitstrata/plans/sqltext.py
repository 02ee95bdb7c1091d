"""Pieces of SQL for the queries' counterparts."""

from gitstrata.functions import exprs as E


def base(c: str) -> str:
    return f"regexp_extract({c}, '[^/]*$')"


def is_test(c: str) -> str:
    ends = "|".join(s.replace(".", r"\.") for s in E.TEST_SUFFIXES)
    return rf"(regexp_matches('/' || lower({c}) || '/', '/({'|'.join(E.TEST_DIRS)})/') or regexp_matches(lower({base(c)}), '({ends})$') or lower({base(c)}) like 'test\_%' escape '\')"


def module_path(c: str) -> str:
    return f"case when contains({c}, '/') then regexp_replace({c}, '/[^/]*$', '') else '' end"


def folder(c: str) -> str:
    return f"case when contains({c}, '/') then split_part({c}, '/', 1) else '/' end"


def bot(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{E.BOT_RE}'), false)"


def pct(a: str, b: str) -> str:
    return f"(case when {b} > 0 then floor(100.0 * {a} / {b} + 0.5) else 0 end)::bigint"


IDENTITY = f"""seen as (select author_name, arg_min(author_login, (ts, sha)) as known from commits where author_login is not null group by author_name),
ids as (select sha, ts, coalesce(author_login, known, c.author_name) as identity from commits c left join seen s on c.author_name = s.author_name)"""

FN_EDGES = """fn_edges as (select distinct * from (select from_file || '|' || from_fn || '|' || coalesce(from_container, '') as src, to_file || '|' || to_fn || '|' || coalesce(to_container, '') as dst
  from calls where from_fn is not null and to_fn is not null) e where src <> dst)"""
PROD_EDGES = f"""fn_edges as (select distinct * from (select from_file || '|' || from_fn || '|' || coalesce(from_container, '') as src, to_file || '|' || to_fn || '|' || coalesce(to_container, '') as dst
  from calls where from_fn is not null and to_fn is not null and not {is_test('from_file')} and not {is_test('to_file')}) e where src <> dst)"""
SAFETY = f"""fan as (select dst as file, count(*) as dependents from file_edges where not {is_test('dst')} group by dst),
tested as (select distinct dst as file from file_edges where {is_test('src')} and not {is_test('dst')}),
bare as (select dst as file, count(*) as untested_dependents from file_edges where not {is_test('src')} and not {is_test('dst')} and src not in (select file from tested) group by dst),
dup_groups as (select body_hash, count(*) as members, count(distinct file) as files, max(complexity) as max_complexity, struct_extract(min(struct_pack(f := file, r := start_row)), 'f') as first
  from functions where body_hash is not null and complexity >= 2 group by body_hash having count(*) >= 2 and count(distinct file) >= 2),
dups as (select file, count(*) as duplicated from functions where complexity >= 2 and body_hash in (select body_hash from dup_groups) group by file),
every as (select file from files union select file from functions union select file from fan),
numbers as (select file, coalesce(dependents, 0) as dependents, coalesce(untested_dependents, 0) as untested_dependents, coalesce(complexity, 0) as complexity, coalesce(duplicated, 0) as duplicated
  from every left join fan using (file) left join bare using (file) left join files using (file) left join dups using (file) where not {is_test('file')}),
safety as (select *, case when dependents >= 8 and (untested_dependents >= 3 or complexity >= 30) then 'load-bearing'
   when dependents >= 8 or (dependents >= 3 and (untested_dependents >= 1 or complexity >= 20)) or duplicated >= 2 then 'handle-with-care'
   when dependents >= 1 or complexity >= 15 or duplicated >= 1 then 'moderate' else 'safe' end as tier,
   2 * dependents + 3 * untested_dependents + 0.5 * complexity + 2 * duplicated as rank
  from numbers where dependents + untested_dependents + complexity + duplicated > 0)"""
DIFF = """changes as (select coalesce(b.file, h.file) as file, coalesce(b.name, h.name) as name, coalesce(b.container, h.container) as container,
  case when h.file is null then 'removed' when b.file is null then 'added' when b.complexity <> h.complexity or coalesce(b.body_hash <> h.body_hash, false) then 'modified' else 'unchanged' end as status,
  b.complexity as complexity_before, h.complexity as complexity_after, h.complexity - b.complexity as delta, b.body_hash <> h.body_hash as body_changed, coalesce(h.start_row, b.start_row) as row
  from base_functions b full join head_functions h on b.file = h.file and b.name = h.name and b.container is not distinct from h.container)"""
EXACT = "case ecosystem when 'npm' then regexp_matches(declared, '^\\d+\\.\\d+\\.\\d+$') when 'cargo' then starts_with(declared, '=') else regexp_matches(declared, '^===?\\s*\\d[^,*\\s]*$') end"
DEPS = f"""one as (select ecosystem, name, declared, case when bool_or(scope = 'runtime' and not regexp_matches(source_path, '{E.NON_SHIPPED_RE}')) then 'runtime' else 'dev' end as scope,
    array_to_string(list_sort(list(distinct source_path))[1:5], ',') as sources from declared_deps group by ecosystem, name, declared),
deps as (select * from (select *, row_number() over (partition by ecosystem order by name, declared) as r from one) x where r <= 300),
current_versions as (select *, regexp_extract(declared, '^[=^~<>! ]*(\\d[^ |,]*)', 1) as cur, {EXACT} as exact from deps),
rows_ as (select c.ecosystem, c.name, declared, scope, sources, cur as current, exact, latest, time_of_current, time_of_latest, deprecated, case when exact then cur else coalesce(latest, cur) end as version
  from current_versions c left join registry_meta r on c.ecosystem = r.ecosystem and c.name = r.name where case ecosystem when 'npm' then regexp_matches(declared, '^[\\^~>=< ]*\\d+\\.\\d+') when 'cargo' then regexp_matches(declared, '^[\\^~>=< ]*\\d') else regexp_matches(declared, '^[=<>!~ ]*\\d') end)"""
DEPS = DEPS.replace("where case ecosystem", "where case c.ecosystem")
