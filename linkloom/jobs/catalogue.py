"""All registered queries of the linkage library, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import COLORS
from linkloom.functions.fuzzy import indel_ratio, wratio
from linkloom.functions.text import normalize_author, normalize_hex, normalize_spine_color, normalize_text, parse_flag, parse_year, split_pipe_list, strip, strip_accents
from linkloom.jobs.views import SPARK_VIEWS, Views, ctes, duck
from linkloom.operators import boxes as B
from linkloom.operators import lifecycle as L
from linkloom.operators import matching as M
from linkloom.operators import reports as R
from linkloom.operators import responses as P
from linkloom.operators.search import search_catalog
from linkloom.sources.catalog import current_catalog, numbered, read_catalog, read_responses, replace_catalog, scan_documents, store_buckets, upsert_buckets, upsert_catalog, write_detections, write_responses
from linkloom.streaming.matching import match_stream
from linkloom.tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:  # counts as whole numbers of 64 bits
            SQL[name] = re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(*) filter (where \1)", sql)
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["match_reads"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def stripped(x: str) -> str:
    """Without white space of any kind at its ends."""
    blank = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g')"


OWN_TITLE = stripped("coalesce(custom_title, '')")


def norm(x: str) -> str:
    """Normalised titles in DuckDB."""
    return rf"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '[‘’''`]', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '^(the|a|an) (.)', '\2')"


def spaced(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents({x}), '\.(\S)', '. \1', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    """The words of a name, or of a part of it, punctuation counting as space."""
    return rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def surname(x: str) -> str:
    """All before the first comma, or else the last word; null if there is none."""
    y = spaced(x)
    return f"nullif(case when contains({y}, ',') then array_to_string({words(f'split_part({y}, chr(44), 1)')}, ' ') else list_last({words(y)}) end, '')"


def initials(x: str) -> str:
    """The first letters of the other words; null if there is no surname."""
    y = spaced(x)
    return f"case when {surname(x)} is not null then list_transform(case when contains({y}, ',') then {words(f'substr({y}, strpos({y}, chr(44)) + 1)')} else list_slice({words(y)}, 1, -2) end, lambda w: w[1]) end"


def masks(p: str, t: str) -> str:
    """For each character of t, the bits at which it stands in p (of up to 60 characters)."""
    return f"list_transform(string_split({t}, ''), lambda ch: list_sum(list_transform(range(1, length({p}) + 1), lambda i: case when {p}[i] = ch then 1::bigint << (i - 1)::int else 0::bigint end))::bigint)"


def common(m: str, found: str) -> str:
    """The longest common subsequence of a pattern of m characters and the characters of ``found`` masks: zeros among m bits."""
    full = f"((1::bigint << ({m})::int) - 1)"
    return f"(({m}) - bit_count(list_reduce(list_prepend({full}, {found}), lambda acc, bits: ((acc + (acc & bits)) | (acc - (acc & bits))) & {full})))"


#: Longest common subsequences of the pairs (a, b), and their ratio.
LCS = f"""need as (select distinct case when length(a) <= length(b) then a else b end as p, case when length(a) <= length(b) then b else a end as t from pairs),
lcs as (select p, t, case when p = '' then 0 else {common('length(p)', masks('p', 't'))} end as n from need),
ratio as (select a, b, case when length(a) + length(b) = 0 then 1.0::double else 200::double * n / (length(a) + length(b)) / 100 end as q from pairs join lcs on p = case when length(a) <= length(b) then a else b end and t = case when length(a) <= length(b) then b else a end)"""

#: The weighted ratio of the pairs (a, b): with sorted tokens and token sets where lengths are alike, else with the best window.
WEIGHTED = f"""tok as (select s, array_to_string(list_sort(string_split(s, ' ')), ' ') as ss, list_sort(list_distinct(string_split(s, ' '))) as ws from (select a as s from pairs union select b from pairs)),
base as (select a, b, length(a) as la, length(b) as lb, greatest(length(a), length(b))::double / least(length(a), length(b)) as lr, x.ss as sa, y.ss as sb, array_to_string(x.ws, ' ') as ua, array_to_string(y.ws, ' ') as ub,
  array_to_string(list_filter(x.ws, lambda w: list_contains(y.ws, w)), ' ') as ji, array_to_string(list_filter(x.ws, lambda w: not list_contains(y.ws, w)), ' ') as ja, array_to_string(list_filter(y.ws, lambda w: not list_contains(x.ws, w)), ' ') as jb
  from pairs join tok x on x.s = a join tok y on y.s = b where a <> '' and b <> ''),
two as (select a as x, b as y from base union select sa, sb from base where lr < 1.5 union select ja, jb from base where lr < 1.5),
need as (select distinct case when length(x) <= length(y) then x else y end as p, case when length(x) <= length(y) then y else x end as t from two),
lcs as (select p, t, case when p = '' then 0 else {common('length(p)', masks('p', 't'))} end as n from need),
both_ways as (select p, t, n from lcs union select t, p, n from lcs),
wide as (select a as x, b as y from base where lr >= 1.5 union select sa, sb from base where lr >= 1.5 and ji = '' union select ua, ub from base where lr >= 1.5 and ji = '' and (sa <> ua or sb <> ub)),
sides as (select x, y, x as p, y as t from wide where length(x) <= length(y) union select x, y, y, x from wide where length(y) <= length(x)),
masked as (select x, y, length(p) as m, length(t) as n, {masks('p', 't')} as mt from sides),
windowed as (select x, y, max(list_max(list_transform(range(1 - m, n), lambda s: 200::double * {common('m', 'list_slice(mt, greatest(s, 0) + 1, least(s + m, n))')} / (m + least(s + m, n) - greatest(s, 0))))) as q from masked group by 1, 2),
parts as (select base.*, 200::double * r.n / (la + lb) as plain, 200::double * o.n / (la + lb) as sorted, length(ji) as s, (ji <> '')::int as gap, length(ja) as na, length(jb) as nb, d.n as nd, w.q as q1, v.q as q2, u.q as q3, case when lr <= 8 then 0.9::double else 0.6::double end as scale
  from base join both_ways r on r.p = a and r.t = b left join both_ways o on o.p = sa and o.t = sb and lr < 1.5 left join both_ways d on d.p = ja and d.t = jb and lr < 1.5
  left join windowed w on w.x = a and w.y = b left join windowed v on v.x = sa and v.y = sb and ji = '' left join windowed u on u.x = ua and u.y = ub and ji = ''),
sets as (select *, case when s > 0 and (na = 0 or nb = 0) then 100::double else greatest(case when 2 * (s + gap) + na + nb = 0 then 100::double else 100::double - 100::double * (na + nb - 2 * nd) / (2 * (s + gap) + na + nb) end,
  case when s > 0 then greatest(100::double - 100::double * (gap + na) / (2 * s + gap + na), 100::double - 100::double * (gap + nb) / (2 * s + gap + nb)) else 0 end) end as by_set from parts),
ratio as (select a, b, (case when lr < 1.5 then greatest(plain, 0.95::double * greatest(sorted, by_set)) else greatest(plain, scale * q1, 0.95::double * scale * case when ji <> '' then 100::double else greatest(q2, coalesce(q3, 0)) end) end) / 100 as q from sets
  union all select a, b, 0::double from pairs where a = '' or b = '')"""


def rec(with_: str) -> str:
    return with_.replace("with ", "with recursive ", 1)


# Columns: text, names, lists, colours

@query("text_normalized", f"select doc_id, {norm('text')} as norm_text from documents")
def _(v):
    return v.table("documents").select("doc_id", normalize_text(F.col("text")).alias("norm_text"))


@query("accents_stripped", "select lang, count(*) as n, sum(length(strip_accents(text)))::bigint as letters from documents group by lang")
def _(v):
    return v.table("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(strip_accents(F.col("text"))).cast("long")).alias("letters"))


@query("authors_parsed", f"{ctes('catalog')} select book_id, {surname('author')} as surname, array_to_string({initials('author')}, ' ') as initials from catalog")
def _(v):
    name = normalize_author(F.col("author"))
    return v.derived("catalog").select("book_id", name["surname"].alias("surname"), F.array_join(name["initials"], " ").alias("initials"))


@query("colors_folded", f"select p_partkey, case when p_partkey % 7 = 0 then 'multicolour' when p_partkey % 7 = 1 then 'beige' end as whole, list_filter(list_reverse(string_split(lower(p_name), ' ')), lambda w: w in {COLORS})[1] as color from part")
def _(v):
    whole = F.when(F.col("p_partkey") % 7 == 0, "Multi-Colour\n").when(F.col("p_partkey") % 7 == 1, "\tCREAM\u00a0")
    return v.table("part").select("p_partkey", normalize_spine_color(whole).alias("whole"), normalize_spine_color(F.col("p_name")).alias("color"))


@query("catalog_fields", """select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' | |' || p_type, '|'), lambda x: trim(x)), lambda x: x <> ''), '/') as items,
  '#' || upper(substr(md5(p_name), 1, 6)) as hex, case when p_size % 4 = 0 then null else 1950 + p_size end::integer as year, p_size % 2 = 0 as flag from part""")
def _(v):
    """Fields with white space of several kinds around them."""
    hexes = normalize_hex(F.concat(F.lit("\t ##"), F.substring(F.md5("p_name"), 1, 6), F.lit("\u00a0\n")))
    year = parse_year(F.when(F.col("p_size") % 4 == 0, "\t\u2003").otherwise(F.concat(F.lit("\t"), (1950 + F.col("p_size")).cast("string"), F.lit("\r\n"))))
    flag = parse_flag(F.when(F.col("p_size") % 2 == 0, " TRUE\n").otherwise("no"))
    return v.table("part").select("p_partkey", F.array_join(split_pipe_list(F.concat("p_name", F.lit("\t| \u00a0|\x1f"), "p_type")), "/").alias("items"), hexes.alias("hex"), year.alias("year"), flag.alias("flag"))


@query("library_display", f"""{ctes('library', 'catalog')} select entry_id, l.book_id, case when custom_title <> '' then custom_title else coalesce(title, '') end as display_title, coalesce(author, '') as display_author,
  concat_ws(' · ', year::varchar, nullif(series, ''), nullif(spine_color, '')) as meta, created_at from library l left join catalog c using (book_id)""")
def _(v):
    return L.library_view(v.derived("library"), v.derived("catalog"))


@query("status_names", f"""{ctes('detections')} select status, case status when 'auto_added' then 'Added' when 'needs_review' then 'Needs review' when 'unmatched' then 'No match' when 'unreadable' then 'Unreadable' when 'failed' then 'Failed' when 'confirmed' then 'Confirmed' else 'Discarded' end as label,
  case when status in ('auto_added', 'confirmed') then 'added' when status <> 'discarded' then 'review' end as bucket, count(*) as n from detections group by 1, 2, 3""")
def _(v):
    s = F.col("status")
    return v.derived("detections").groupBy("status", L.status_label(s).alias("label"), L.status_bucket(s).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Scores and matches

def matched(scorer: str, select: str, *more: str) -> str:
    """Every read against every book, in SQL: ``ranked`` (books of a distinct read in order), ``best`` (the first two) and ``out`` (the decision for each read)."""
    return f"""{rec(ctes('catalog', 'reads', *more))},
r as (select *, {norm('title')} as nt, {surname('author')} as rs, {initials('author')} as ri from reads where {stripped('title')} <> ''),
dr as (select distinct nt, rs, ri from r),
c0 as (select book_id, {norm('title')} as t from catalog union select book_id, {norm('unnest(alt_titles)')} from catalog),
ct as (select * from c0 where t <> ''),
pairs as (select distinct nt as a, t as b from (select distinct nt from dr), (select distinct t from ct)),
{scorer},
cn as (select book_id, {surname('author')} as cs, {initials('author')} as ci from catalog),
names as (select distinct rs as x, cs as y from (select distinct rs from dr where rs is not null), (select distinct cs from cn where cs is not null)),
near as (select x, y, case when x = y then 1::double else 200::double * (case when length(x) <= length(y) then {common('length(x)', masks('x', 'y'))} else {common('length(y)', masks('y', 'x'))} end) / (length(x) + length(y)) / 100 end as q from names),
people as (select rs, ri, cs, ci, q >= 0.85 as is_near, case when q < 0.85 then 0::double when len(ri) = 0 or len(ci) = 0 or ri[1:least(len(ri), len(ci))] = ci[1:least(len(ri), len(ci))] then q else q * 0.5::double end as s
  from (select distinct rs, ri from dr where rs is not null) join near on x = rs join (select distinct cs, ci from cn where cs is not null) on y = cs),
ts as (select nt, book_id, max(q) as t from (select distinct nt from dr) join ratio on a = nt join ct on ct.t = b group by 1, 2),
scored as (select dr.nt, dr.rs, dr.ri, ts.book_id, coalesce(p.is_near, cn.cs is null) as is_near, case when p.s is null then least(t, 0.85::double) else 0.75::double * t + 0.25::double * p.s end as s
  from dr join ts on ts.nt = dr.nt join cn using (book_id) left join people p on p.rs = dr.rs and p.ri = dr.ri and p.cs = cn.cs and p.ci = cn.ci),
ranked as (select *, row_number() over (partition by nt, rs, ri order by s desc, book_id) as k from scored),
best as (select nt, rs, ri, max(case when k = 1 then s end) as s1, max(case when k = 2 then s end) as s2, max(case when k = 1 then book_id end) as b1 from ranked where k <= 2 group by 1, 2, 3),
out as (select reads.read_id, case when s1 is null or s1 < 0.55 then 'unmatched' when s1 >= 0.9 and s1 - coalesce(s2, 0) >= 0.12 then 'auto_added' else 'needs_review' end as match_status, round(s1, 6) as confidence,
  case when s1 >= 0.55 then round(s1 - coalesce(s2, 0), 6) end as margin, case when s1 >= 0.9 and s1 - coalesce(s2, 0) >= 0.12 then b1 end as chosen_book
  from reads left join r on r.read_id = reads.read_id left join best on best.nt = r.nt and best.rs is not distinct from r.rs and best.ri is not distinct from r.ri),
close_ones as (select reads.read_id, reads.spine_color as rc, k.book_id, k.s, k.k, b.s1, b.s1 - coalesce(b.s2, 0) as lead, c.spine_color as cc from reads join r on r.read_id = reads.read_id
  join ranked k on k.nt = r.nt and k.rs is not distinct from r.rs and k.ri is not distinct from r.ri and k.k <= 3 join best b on b.nt = r.nt and b.rs is not distinct from r.rs and b.ri is not distinct from r.ri join catalog c on c.book_id = k.book_id),
tied as (select read_id, any_value(s1) as s1, any_value(lead) as lead, count_if(s1 - s <= 0.05) as tied, count_if(s1 - s <= 0.05 and cc = rc) as same, max(case when s1 - s <= 0.05 and cc = rc then book_id end) as colored, max(case when k = 1 then book_id end) as leader from close_ones group by 1),
shown as (select read_id, case when s1 >= 0.55 and lead <= 0.05 and tied >= 2 and same = 1 then colored else leader end as shown_book from tied),
listed as (select read_id, book_id, s, row_number() over (partition by read_id order by book_id <> shown_book, k) as rank from close_ones join shown using (read_id))
{select}"""


#: The candidates of each read, best first.
IDS = "ids as (select read_id, string_agg(book_id::varchar, ',' order by rank) as candidates from listed group by 1)"
#: Distinct titles of reads and of their candidates.
NEAR_TITLES = f"select distinct a, b, round(q, 6) as ratio from (select distinct nt, book_id from ranked where k <= 3) join catalog using (book_id) join ratio on a = nt and b = {norm('title')}"


def title_pairs(v: Views) -> DataFrame:
    """Distinct normalised titles of reads and of the candidates that the match gives them."""
    found = M.match_reads(v.derived("reads"), v.derived("catalog")).select("title", F.explode("candidates").alias("c"))
    titles = found.select("title", F.col("c.title").alias("other")).distinct()
    return titles.select(normalize_text(F.col("title")).alias("a"), normalize_text(F.col("other")).alias("b")).distinct()


@query("indel_ratios", matched(f"{WEIGHTED}", NEAR_TITLES.replace("ratio on a = nt", "plain_ratio on a = nt")).replace("cn as (select", "plain_ratio as (select a, b, plain / 100 as q from parts),\ncn as (select", 1))
def _(v):
    return title_pairs(v).select("a", "b", F.round(indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("weighted_ratios", matched(WEIGHTED, NEAR_TITLES))
def _(v):
    return title_pairs(v).select("a", "b", F.round(wratio(F.col("a"), F.col("b")), 6).alias("ratio"))


#: Two openings of each text, the first of up to 120 characters, the second of up to 200, from another place or another text.
LONG = f"""d as (select row_number() over (order by doc_id) as n, text from documents where text is not null),
  raw as (select substr(x.text, 1, (66 + x.n % 50)::int) as a, case when x.n % 3 = 0 then substr(y.text, 1, (70 + x.n % 120)::int) else substr(x.text, (1 + x.n % 40)::int, (70 + x.n * 7 % 120)::int) end as b from d x join d y on y.n = case when x.n > 1 then x.n - 1 else (select max(n) from d) end),
  pairs as (select distinct {norm('a')} as a, {norm('b')} as b from raw)"""


@query("long_title_ratios", f"with {LONG}, {WEIGHTED.replace('::bigint', '::hugeint')} select a, b, round(q, 6) as ratio from ratio")
def _(v):
    """Weighted ratios of titles of 65 to 200 characters."""
    d = numbered(v.table("documents").where("text is not null").select("doc_id", "text"), ["doc_id"], 0).select(F.col("book_id").alias("n"), "text")
    n = d.count()
    other = d.select((F.col("n") % n + 1).alias("n"), F.col("text").alias("other"))  # the text before, of the first one the last
    raw = d.join(other, "n").selectExpr("substr(text, 1, cast(66 + n % 50 as int)) as a", "case when n % 3 = 0 then substr(other, 1, cast(70 + n % 120 as int)) else substr(text, cast(1 + n % 40 as int), cast(70 + n * 7 % 120 as int)) end as b")
    pairs = raw.select(normalize_text(F.col("a")).alias("a"), normalize_text(F.col("b")).alias("b")).distinct()
    return pairs.select("a", "b", F.round(wratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("read_id", *more, "match_status", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "chosen_book")


@query("match_reads", matched(WEIGHTED, """, ids as (select read_id, string_agg(book_id::varchar, ',' order by rank) as candidates from listed group by 1)
  select out.read_id, title, author, coalesce(candidates, '') as candidates, match_status, confidence, margin, chosen_book from out join reads on reads.read_id = out.read_id left join ids on ids.read_id = out.read_id"""))
def _(v):
    """Every read against the whole catalog, by the weighted ratio."""
    found = M.match_reads(v.derived("reads"), v.derived("catalog"))
    ids = F.array_join(F.transform("candidates", lambda c: c["book_id"].cast("string")), ",")
    return rounded(found.withColumn("candidates", F.coalesce(ids, F.lit(""))), "title", "author", "candidates")


@query("match_reads_plain", matched(LCS, "select * from out"))
def _(v):
    """The same with the plain ratio."""
    return rounded(M.match_reads(v.derived("reads"), v.derived("catalog"), scorer="ratio"))


@query("match_shown", matched(WEIGHTED, "select * from shown"))
def _(v):
    """The candidate that is shown first, near-ties settled by colour."""
    found = M.match_reads(v.derived("reads"), v.derived("catalog"))
    return found.where(strip(F.col("title")) != "").select("read_id", F.get("candidates", F.lit(0))["book_id"].alias("shown_book"))


@query("match_candidates", matched(WEIGHTED, """select read_id, rank::integer as rank, l.book_id, c.title, c.author, floor(s * 10000 + 0.5000001) / 10000 as score, c.year::integer as year, c.series, c.spine_color, c.spine_hex from listed l join catalog c using (book_id)"""))
def _(v):
    """What detections store of their candidates."""
    found = M.match_reads(v.derived("reads"), v.derived("catalog")).select("read_id", F.posexplode(M.candidates_payload(F.col("candidates"))).alias("at", "c"))
    return found.select("read_id", (F.col("at") + 1).alias("rank"), "c.*")


@query("match_auto_blocked", matched(WEIGHTED, """, met as (select *, row_number() over (partition by nt, rs, ri order by s desc, book_id) as m from scored where rs is not null and is_near),
  lead2 as (select nt, rs, ri, max(case when m = 1 then s end) - coalesce(max(case when m = 2 then s end), 0) as lead from met where m <= 2 group by 1, 2, 3)
  select out.read_id, chosen_book, confidence, round(lead, 6) as margin_upper from out join r on r.read_id = out.read_id join lead2 on lead2.nt = r.nt and lead2.rs = r.rs and lead2.ri = r.ri where match_status = 'auto_added'"""))
def _(v):
    """Automatic matches found through blocks of like surnames, and what can spoil them."""
    found = M.match_reads(v.derived("reads"), v.derived("catalog"), mode="blocked")
    return found.where("match_status = 'auto_added'").select("read_id", "chosen_book", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin_upper"))


@query("match_review", matched(WEIGHTED, f""", {IDS} select out.read_id, match_status, confidence, chosen_book, case when match_status = 'auto_added' then '' else coalesce(candidates, '') end as candidates from out left join ids on ids.read_id = out.read_id"""))
def _(v):
    """Automatic matches through blocks, the candidates of all other reads from the whole catalog."""
    found = M.match_reads(v.derived("reads"), v.derived("catalog"), mode="review")
    ids = F.when(F.col("match_status") != "auto_added", F.array_join(F.transform("candidates", lambda c: c["book_id"].cast("string")), ","))
    return found.select("read_id", "match_status", F.round("confidence", 6).alias("confidence"), "chosen_book", F.coalesce(ids, F.lit("")).alias("candidates"))


@query("match_buckets", matched(WEIGHTED, "select match_status as status, count(*) as n from out group by 1"))
def _(v):
    return R.match_buckets(M.match_reads(v.derived("reads"), v.derived("catalog")).select(F.col("match_status").alias("status")))


@query("distinct_reads", f"{ctes('reads')} select count(*) as n, count(distinct norm_title) as titles from (select distinct {norm('title')} as norm_title, coalesce({surname('author')} || '/' || array_to_string({initials('author')}, ' '), '') as a from reads where {stripped('title')} <> '')")
def _(v):
    return M.distinct_reads(v.derived("reads")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("norm_title").alias("titles"))


#: Only a status discards, not the flag of a read that could be read.
FATES = """fates as (select r0.scan_id, r0.read_id, case when r0.status in ('not_a_book', 'duplicate') then 'discarded' when not r0.readable or coalesce(r0.title, '') = '' then case when r0.status = 'failed' then 'failed' else 'unreadable' end else o.match_status end as st from reads r0 join out o using (read_id))"""


@query("routed_scans", matched(WEIGHTED, f""", {FATES} select scan_id, count_if(st in ('auto_added', 'confirmed')) as added, count_if(st in ('needs_review', 'unmatched', 'unreadable', 'failed')) as review,
  count_if(st = 'auto_added') as auto_added, count_if(st = 'needs_review') as needs_review, count_if(st = 'unmatched') as unmatched, count_if(st = 'unreadable') as unreadable, count_if(st = 'failed') as failed, count_if(st = 'confirmed') as confirmed, count_if(st = 'discarded') as discarded from fates group by 1"""))
def _(v):
    return R.scan_summary(L.route_reads(v.derived("reads"), v.derived("catalog")))


ROUTED = f""", {FATES}, {IDS}, routed as (select r.read_id, r.scan_id, r.slot, r.title, r.author, f.st as status, case when f.st in ('auto_added', 'needs_review', 'unmatched') then o.confidence end as confidence, case when f.st in ('auto_added', 'needs_review') then o.margin end as margin,
  case when f.st = 'auto_added' then o.chosen_book end as chosen_book, case when f.st in ('auto_added', 'needs_review', 'unmatched') then coalesce(i.candidates, '') else '' end as candidates
  from reads r join fates f on f.read_id = r.read_id join out o on o.read_id = r.read_id left join ids i on i.read_id = r.read_id)"""


def with_candidates(routed: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("candidates", lambda c: c["book_id"].cast("string")), ",")
    return routed.select("read_id", "scan_id", "slot", "title", "author", "status", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "chosen_book", ids.alias("candidates"))


@query("routed_reads", matched(WEIGHTED, f"{ROUTED} select * from routed"))
def _(v):
    """What becomes of each read, and its candidates."""
    return with_candidates(L.route_reads(v.derived("reads"), v.derived("catalog")))


@query("review_candidates", matched(WEIGHTED, f"{ROUTED} select read_id, scan_id, slot, status, candidates from routed where status in ('needs_review', 'unmatched', 'unreadable', 'failed')"))
def _(v):
    """The review queue with the candidates that a person is shown."""
    return with_candidates(L.review_queue(L.route_reads(v.derived("reads"), v.derived("catalog")))).select("read_id", "scan_id", "slot", "status", "candidates")


@query("stream_routed", matched(WEIGHTED, f"{ROUTED} select * from routed"))
def _(v):
    """The same from a stream of files, in which every third read is sent once more by later files, after a stop."""
    folder = f"{shared_dir(v.spark)}/stream-{uuid4().hex}"
    reads = v.derived("reads").withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("read_id"), F.lit(3600))))
    prepared = M.prepare(v.derived("catalog"))
    for some in ("read_id % 2 = 0", "read_id % 2 = 1 or read_id % 3 = 0"):
        reads.where(some).write.mode("append").parquet(f"{folder}/in")
        stream = v.spark.readStream.schema(reads.schema).parquet(f"{folder}/in")
        match_stream(stream, prepared, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return with_candidates(v.spark.read.parquet(f"{folder}/out"))


@query("auto_confirmed", matched(WEIGHTED, f", {FATES} select chosen_book as book_id, count(*) as n from out join fates using (read_id) where st = 'auto_added' group by 1"))
def _(v):
    routed = L.route_reads(v.derived("reads"), v.derived("catalog"))
    rows = L.auto_confirm(routed.withColumn("detection_id", F.col("read_id")).withColumn("created_at", F.lit(None).cast("timestamp")))
    return rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_search", f"""{ctes('catalog')}, q as (select n_nationkey as query_id, lower(substr(n_name, 1, 2)) as q from nation union all select 100 + r_regionkey, 'ring' from region union all select 200, 'RED w')
  select query_id, row_number() over (partition by query_id order by book_id)::integer as rank, book_id from q join catalog on contains(lower(title), lower(q)) or contains(lower(author), lower(q)) qualify rank <= 20""")
def _(v):
    one = v.table("nation").select(F.col("n_nationkey").alias("query_id"), F.lower(F.substring("n_name", 1, 2)).alias("q"))
    two = v.table("region").select((F.col("r_regionkey") + 100).alias("query_id"), F.lit("ring").alias("q"))
    asked = one.unionAll(two).unionAll(v.table("region").select(F.lit(200).alias("query_id"), F.lit("\u00a0RED w\n").alias("q")).distinct())
    return search_catalog(asked, v.derived("catalog")).select(F.col("query_id").cast("long").alias("query_id"), "rank", "book_id")


# Model responses

def sliced(text: str) -> str:
    """From the first to the last bracket; what is no number is a true one, the first of two titles doesn't count. It may be no JSON."""
    return rf"""replace(regexp_replace(regexp_extract({text}, '\[.*\]', 0, 's'), ': (NaN|-Infinity)', ': 0.5', 'g'), '"title": "Draft", ', '')"""


ALIGNED = f"""{ctes('responses')},
chosen as (select *, {sliced('raw_text')} as j1, {sliced('repair_text')} as j2 from responses),
o as (select *, case when call_failed then 'failed' when json_valid(j1) then 'parsed' when repair_failed then 'failed' when json_valid(j2) then 'parsed' else 'unreadable' end as outcome, case when json_valid(j1) then j1 else j2 end as j from chosen),
s as (select scan_id, n_crops, outcome, unnest(range(1, n_crops + 1)) as slot, j from o),
i as (select scan_id, slot, outcome, case when outcome = 'parsed' then json_extract(j, '$[' || (slot - 1) || ']') end as item from s),
f as (select scan_id, slot, outcome, item, coalesce(item->>'readable' in ('true', '0.5') and item->>'title' <> '', false) as ok, item->>'author' as author, coalesce(item->>'not_a_book' = 'true', false) as nab, (item->>'duplicate_of') = '1' and slot <> 1 as pts,
  case when item->>'spine_color' = 'pale Navy' then 'blue' end as spine_color from i),
reads2 as (select scan_id, slot::integer as slot, case when ok then item->>'title' end as title, author, spine_color, nab as not_a_book, ok and not coalesce(pts, false) as readable,
  case when outcome <> 'parsed' then outcome when ok and coalesce(pts, false) then 'duplicate' when nab and not ok then 'not_a_book' when ok then 'ok' else 'unreadable' end as status from f)"""


@query("reads_aligned", f"{ALIGNED} select * from reads2")
def _(v):
    return P.align_reads(v.derived("responses"))


@query("read_quality", f"{ALIGNED} select scan_id, count(*) as total, count_if(status = 'ok') as ok, count_if(status = 'duplicate') as duplicates, round(avg((status = 'ok')::int), 6) as ok_share from reads2 group by 1")
def _(v):
    return R.read_quality(P.align_reads(v.derived("responses"))).withColumn("ok_share", F.round("ok_share", 6))


@query("reads_fallback", f"""{ctes('responses')}, c as (select scan_id, {sliced('raw_text')} as j from responses where not call_failed),
  i as (select scan_id, unnest(range(0, json_array_length(j)::bigint)) as n, j from c where json_valid(j))
  select scan_id, row_number() over (partition by scan_id order by n)::integer as slot, json_extract(j, '$[' || n || ']')->>'title' as title, json_extract(j, '$[' || n || ']')->>'author' as author, json_extract(j, '$[' || n || ']')->>'spine_color' as spine_color from i where json_extract(j, '$[' || n || ']')->>'title' <> ''""")
def _(v):
    return P.fallback_reads(v.derived("responses"))


# Boxes

CLEANED = f"""{ctes('boxes')}, d as (select scan_id, ord, conf, x1::int as x1, y1::int as y1, x2::int as x2, y2::int as y2, image_width from boxes where cls = 'book' and conf >= 0.25),
s as (select *, (x2 > x1 and (y2 - y1) >= 2.5 * (x2 - x1)) as ok from d), s2 as (select * from s qualify ok or not bool_or(ok) over (partition by scan_id)),
w as (select *, (x2 - x1) >= 0.015 * image_width as wide from s2), w2 as (select scan_id, ord, x1, y1, x2, y2 from w qualify wide or not bool_or(wide) over (partition by scan_id))"""


@query("boxes_filtered", f"{CLEANED} select * from w2")
def _(v):
    return B.sliver_filter(B.spine_shape_filter(B.filter_detections(v.derived("boxes")))).select("scan_id", "ord", *B.SIDES)


def overlap(a: str, b: str) -> str:
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)::bigint * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"


def same_box(a: str, b: str) -> str:
    area = lambda x: f"({x}.x2 - {x}.x1)::bigint * ({x}.y2 - {x}.y1)"
    wide = lambda f: f"{f}({a}.x2 - {a}.x1, {b}.x2 - {b}.x1)"
    return f"({overlap(a, b)} / ({area(a)} + {area(b)} - {overlap(a, b)}) >= 0.55::double or ({overlap(a, b)} / least({area(a)}, {area(b)}) >= 0.8::double and {wide('least')} / {wide('greatest')} >= 0.6::double))"


def merged(with_: str, photo: str, same: str) -> str:
    """Boxes of a scan and what is known of the ``photo`` folded, two boxes being ``same``."""
    return rec(with_).replace("select scan_id, ord, x1, y1, x2, y2 from w", "select scan_id, ord, conf, x1, y1, x2, y2, image_width from w") + f""",
l0 as (select scan_id, any_value(image_width) as iw, list(struct_pack(conf := conf, x1 := x1, y1 := y1, x2 := x2, y2 := y2, n := 1) order by conf desc, ord) as bs, count(*) as c from w2 group by 1),
l as ({photo}),
fold as (select scan_id, 0 as i, bs[1:0] as kept from l
  union all select scan_id, i + 1, case when coalesce(place, 0) = 0 then list_append(kept, b) else list_transform(kept, lambda k, j: case when j = place then struct_pack(conf := k.conf, x1 := least(k.x1, b.x1), y1 := least(k.y1, b.y1), x2 := greatest(k.x2, b.x2), y2 := greatest(k.y2, b.y2), n := k.n + 1) else k end) end
  from (select f.scan_id, f.i, f.kept, l.bs[f.i + 1] as b, list_position(list_transform(f.kept, lambda k: {same}), true) as place from fold f join l on l.scan_id = f.scan_id where f.i < l.c)),
each_box as (select fold.scan_id, iw, unnest(range(1, len(kept) + 1)) as pos, kept from fold join l on l.scan_id = fold.scan_id and i = c),
flat as (select scan_id, iw, pos, kept[pos].conf as conf, kept[pos].x1 as x1, kept[pos].y1 as y1, kept[pos].x2 as x2, kept[pos].y2 as y2, kept[pos].n as n from each_box),
padded as (select *, greatest(x1 - 6, 0) as cx1, greatest(y1 - 6, 0) as cy1, least(x2 + 6, iw) as cx2, least(y2 + 6, 900) as cy2 from flat)
select scan_id, row_number() over (partition by scan_id order by x1, pos)::integer as slot, x1, y1, x2, y2, round(conf, 6) as conf, n as n_merged, cx1, cy1, cx2, cy2, case when cx2 > cx1 then (cy2 - cy1) / (cx2 - cx1) >= 1.15::double else false end as rotate from padded"""


#: The greedy fold: box after box, by falling confidence, joins the first kept one that shows the same.
MERGED = merged(CLEANED, "select * from l0", same_box("k", "l.bs[f.i + 1]"))


def divided(a: str, b: str) -> str:
    """Edge points of each column of the overlap, then the rule: one column has many, and twice as many as the middle one."""
    x1, y1, x2, y2 = (f"{f}({a}.{c}, {b}.{c})" for f, c in (("greatest", "x1"), ("greatest", "y1"), ("least", "x2"), ("least", "y2")))
    hits = f"list_transform(range({x1}, {x2}), lambda x: coalesce(list_sum(list_transform(list_filter(l.es, lambda e: e.x = x), lambda e: greatest(0, least(e.y2, {y2}) - greatest(e.y1, {y1})))), 0))"
    return f"({x2} - {x1} >= 2 and {y2} - {y1} >= 2 and list_max({hits}) >= 0.3::double * ({y2} - {y1}) and list_max({hits}) >= 2 * list_median({hits}))"


@query("boxes_merged_edges", merged(CLEANED.replace(", d as (", f", edges as ({duck(SPARK_VIEWS['edges'][0])}), d as (", 1), "select l0.*, coalesce(es, []) as es from l0 left join (select scan_id, list(struct_pack(x := x, y1 := y1, y2 := y2)) as es from edges group by 1) using (scan_id)",
  f"case when {same_box('k', 'l.bs[f.i + 1]')} then not {divided('k', 'l.bs[f.i + 1]')} else false end"))
def _(v):
    """The same where edges divide boxes; a box that has grown is looked at as it is."""
    found = B.clean_boxes(v.derived("boxes"), v.derived("edges"))
    return found.select("scan_id", "slot", *B.SIDES, F.round("conf", 6).alias("conf"), "n_merged", "cx1", "cy1", "cx2", "cy2", "rotate")


@query("boxes_merged", MERGED)
def _(v):
    """Raw boxes to merged spines in reading order, and their crops."""
    return B.clean_boxes(v.derived("boxes")).select("scan_id", "slot", *B.SIDES, F.round("conf", 6).alias("conf"), "n_merged", "cx1", "cy1", "cx2", "cy2", "rotate")


@query("box_geometry", f"""{ctes('boxes')}, b as (select scan_id, ord, x1::bigint as x1, y1::bigint as y1, x2::bigint as x2, y2::bigint as y2 from boxes),
  p as (select a.scan_id, a.ord, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, c.x1, c.y1, c.x2, c.y2 from b a join b c on a.scan_id = c.scan_id and c.ord = a.ord + 1),
  m as (select *, greatest(least(ax2, x2) - greatest(ax1, x1), 0) * greatest(least(ay2, y2) - greatest(ay1, y1), 0) as i, (ax2 - ax1) * (ay2 - ay1) as a1, (x2 - x1) * (y2 - y1) as a2 from p)
  select scan_id, ord, round(i / (a1 + a2 - i), 6) as iou, round(i / least(a1, a2), 6) as containment, round(least(ax2 - ax1, x2 - x1) / greatest(ax2 - ax1, x2 - x1), 6) as width_ratio, (greatest(ax2, x2) - least(ax1, x1)) * (greatest(ay2, y2) - least(ay1, y1)) as union_area from m""")
def _(v):
    box = v.derived("boxes").select("scan_id", "ord", F.struct(*[F.col(c).cast("long").alias(c) for c in B.SIDES]).alias("a"))
    other = box.select("scan_id", (F.col("ord") - 1).alias("ord"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    r = lambda c: F.round(c, 6)
    return box.join(other, ["scan_id", "ord"]).select("scan_id", "ord", r(B.iou(a, b)).alias("iou"), r(B.containment(a, b)).alias("containment"), r(B.width_ratio(a, b)).alias("width_ratio"), B.box_area(B.union_box(a, b)).alias("union_area"))


@query("dividers", """select l_orderkey, (count(*) >= 2 and max(l_linenumber) >= 0.3 * 12 and max(l_linenumber) >= 2 * median(l_linenumber)) as divides from lineitem group by 1""")
def _(v):
    hits = v.table("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("hits"))
    return hits.select("l_orderkey", B.divider_decision(F.col("hits"), F.lit(12)).alias("divides"))


# Library and review

ACTED = f"""{ctes('actions', 'catalog', 'detections')}, chk as (select a.*, case action when 'confirm' then c.book_id is not null or (a.book_id is null and {OWN_TITLE} <> '') when 'retry' then has_crop else true end as valid
  from actions a left join (select book_id from catalog) c on c.book_id = a.book_id)"""


@query("actions_checked", f"{ACTED} select action, valid, count(*) as n from chk group by 1, 2")
def _(v):
    return L.checked_actions(v.derived("actions"), v.derived("catalog")).groupBy("action", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("review_applied", f"""{ACTED}, last as (select detection_id, arg_max(action, (ts, action_id)) as action from chk where valid and action <> 'retry' group by 1),
  chose as (select detection_id, arg_max(struct_pack(b := book_id), (ts, action_id)).b as book from chk where valid and action = 'confirm' group by 1)
  select d.detection_id, case last.action when 'confirm' then 'confirmed' when 'discard' then 'discarded' else d.status end as status, case when chose.detection_id is not null then chose.book else d.chosen_book end as chosen_book
  from detections d left join last using (detection_id) left join chose using (detection_id)""")
def _(v):
    """The latest action names the status; the book is that of the latest confirmation, which a discard keeps."""
    checked = L.checked_actions(v.derived("actions"), v.derived("catalog"))
    return L.apply_review_actions(v.derived("detections"), checked).select("detection_id", "status", "chosen_book")


@query("review_retried", matched(WEIGHTED, f""", {FATES}, chk as (select a.*, case action when 'confirm' then c.book_id is not null or (a.book_id is null and {OWN_TITLE} <> '') when 'retry' then has_crop and exists (select 1 from reads where read_id = a.detection_id) and exists (select 1 from detections d where d.detection_id = a.detection_id) else true end as valid
    from actions a left join (select book_id from catalog) c on c.book_id = a.book_id),
  last as (select detection_id, arg_max(action, (ts, action_id)) as action from chk where valid group by 1),
  chose as (select detection_id, arg_max(struct_pack(a := action, b := book_id), (ts, action_id)) as x from chk where valid and action <> 'discard' group by 1),
  again as (select read_id as detection_id, st, case when st = 'auto_added' then chosen_book end as book from fates join out using (read_id))
  select d.detection_id, case last.action when 'confirm' then 'confirmed' when 'discard' then 'discarded' when 'retry' then again.st else d.status end as status,
    case when x is null then d.chosen_book when x.a = 'confirm' then x.b else again.book end as chosen_book
  from detections d left join last using (detection_id) left join chose using (detection_id) left join again using (detection_id)""", "actions", "detections"))
def _(v):
    """Confirmations, discards and new reads of detections, in the order they came."""
    checked, reads = L.checked_actions(v.derived("actions"), v.derived("catalog")), v.derived("reads").withColumnRenamed("read_id", "detection_id").drop("scan_id", "slot")
    again = L.retried(v.derived("detections"), checked, reads, v.derived("catalog"))
    return L.apply_review_actions(v.derived("detections"), checked, again).select("detection_id", "status", "chosen_book")


@query("entries_confirmed", f"{ACTED} select book_id, case when book_id is null then {OWN_TITLE} else '' end as custom_title, detection_id as source_detection_id from chk where valid and action = 'confirm'")
def _(v):
    return L.confirmed_entries(L.checked_actions(v.derived("actions"), v.derived("catalog"))).select("book_id", "custom_title", "source_detection_id")


@query("library_edited", f"""{ctes('library', 'actions')}, e as (select action_id, action_id * 2 // 3 as entry_id, case action when 'discard' then 'delete' else 'edit' end as kind, case when action_id % 3 > 0 then 'Edit ' || action_id end as t, case when action_id % 3 <> 1 then 'By ' || action_id end as w, ts from actions),
  l as (select entry_id, arg_max(t, (ts, action_id)) filter (where t is not null) as t, arg_max(w, (ts, action_id)) filter (where w is not null) as w from e where kind = 'edit' group by 1)
  select entry_id, coalesce(l.t, custom_title) as custom_title, coalesce(l.w, custom_author) as custom_author from library left join l using (entry_id) where entry_id not in (select entry_id from e where kind = 'delete')""")
def _(v):
    """Edits of one field or both; each field takes its latest."""
    i, text = F.col("action_id"), F.col("action_id").cast("string")
    edits = v.derived("actions").select("action_id", F.expr("action_id * 2 div 3").alias("entry_id"), F.when(F.col("action") == "discard", "delete").otherwise("edit").alias("kind"), F.when(i % 3 > 0, F.concat(F.lit("Edit "), text)).alias("custom_title"), F.when(i % 3 != 1, F.concat(F.lit("By "), text)).alias("custom_author"), "ts")
    return L.edit_library(v.derived("library"), edits).select("entry_id", "custom_title", "custom_author")


@query("library_orphans", f"{ctes('library', 'catalog')} select entry_id, book_id from library where custom_title = '' and (book_id is null or book_id not in (select book_id from catalog))")
def _(v):
    return L.orphaned_entries(v.derived("library"), v.derived("catalog")).select("entry_id", "book_id")


@query("library_snapshot", f"{ctes('library', 'catalog')} select entry_id, case when custom_title <> '' then custom_title else coalesce(title, '') end as custom_title, coalesce(author, '') as custom_author from library left join catalog using (book_id)")
def _(v):
    return L.snapshot_library(v.derived("library"), v.derived("catalog")).select("entry_id", "custom_title", "custom_author")


@query("omnibus_volumes", f"{ctes('catalog')}, o as (select book_id, unnest(contained_titles) as volume from catalog where is_omnibus) select book_id, volume, {norm('volume')} in (select {norm('title')} from catalog) as is_present from o")
def _(v):
    return L.omnibus_volumes(v.derived("catalog"))


@query("review_queue", f"{ctes('detections')} select detection_id, scan_id, slot, status from detections where status in ('needs_review', 'unmatched', 'unreadable', 'failed')")
def _(v):
    return L.review_queue(v.derived("detections")).select("detection_id", "scan_id", "slot", "status")


@query("scan_statuses", f"""{ctes('detections', 'boxes')}, s as (select o_orderkey as scan_id, o_orderkey % 29 = 0 as error from orders), b as (select scan_id, count(*) as n from boxes where conf > 0.5 group by 1), r as (select scan_id, count(*) as n from detections group by 1)
  select s.scan_id, case when error then 'failed' else 'done' end as status, b.n is null as used_fallback, b.n is null and r.n is null and not error as empty_result from s left join b using (scan_id) left join r using (scan_id)""")
def _(v):
    scans = v.table("orders").select(F.col("o_orderkey").alias("scan_id"), (F.col("o_orderkey") % 29 == 0).alias("error"))
    return L.scan_status(scans, v.derived("boxes").where("conf > 0.5"), v.derived("detections"))


@query("scan_documents", f"""{ctes('detections')}, d as (select scan_id, count(*) as n, string_agg('{{"detection_id":' || detection_id || ',"slot":' || slot || ',"status":"' || status || '","chosen_book":' || coalesce(chosen_book::varchar, 'null') || '}}', ',' order by detection_id) as items from detections group by 1)
  select o_orderkey as scan_id, coalesce(n, 0)::integer as n_detections, '{{"scan_id":' || o_orderkey || ',"detections":[' || coalesce(items, '') || ']}}' as document from orders left join d on scan_id = o_orderkey""")
def _(v):
    """A JSON document of each scan, word for word."""
    return scan_documents(v.table("orders").select(F.col("o_orderkey").alias("scan_id")), v.derived("detections").drop("created_at"))


UPSERTED = f"""{ctes('catalog')}, old as (select *, ({norm('title')}, {surname('author')}, {initials('author')}, year) as key from catalog), fresh as (select book_id, case when book_id % 2 = 0 then title else title || ' II' end as title, author, year from catalog),
  n as (select title, author, year, ({norm('title')}, {surname('author')}, {initials('author')}, year) as key from fresh), added as (select n.*, row_number() over (order by {norm('title')}, {surname('author')} nulls first, {initials('author')} nulls first, year) as nth from n where key not in (select key from old))
  select book_id, case when n.title is null then '' else 'New' end as series, coalesce(n.title, old.title) as title, coalesce(n.author, old.author) as author from old left join n on n.key = old.key
  union all select (select max(book_id) from old) + nth, 'New', title, author from added"""


def half_new(v: Views) -> tuple[DataFrame, DataFrame]:
    """A catalog, and rows of which half have its keys, half are new."""
    catalog = v.derived("catalog").withColumn("series", F.lit(""))
    return catalog, catalog.withColumn("title", F.when(F.col("book_id") % 2 == 0, F.col("title")).otherwise(F.concat("title", F.lit(" II")))).withColumn("series", F.lit("New"))


@query("catalog_upserted", UPSERTED)
def _(v):
    """Half of the rows replace those of the same key, half are new and get ids after the largest, in the order of their keys; books without an author may share a key."""
    return upsert_catalog(*half_new(v), twice="join").select("book_id", "series", "title", "author")


@query("catalog_upserted_buckets", UPSERTED)
def _(v):
    """The same in a stored catalog, of which only the touched buckets are written."""
    path = f"{shared_dir(v.spark)}/buckets-{uuid4().hex}"
    catalog, incoming = half_new(v)
    store_buckets(catalog, path)
    upsert_buckets(v.spark, path, incoming, twice="join")
    return v.spark.read.parquet(path).select("book_id", "series", "title", "author")



FLAT = "select book_id, title, author, array_to_string(alt_titles, '/') as alt_titles, year::integer as year, series, is_omnibus, array_to_string(contained_titles, '/') as contained_titles, spine_color, spine_hex"


def flat(catalog: DataFrame) -> DataFrame:
    return catalog.select("book_id", "title", "author", F.array_join("alt_titles", "/").alias("alt_titles"), "year", "series", "is_omnibus", F.array_join("contained_titles", "/").alias("contained_titles"), "spine_color", "spine_hex")


@query("catalog_read", f"{ctes('catalog')} {FLAT} from catalog")
def _(v):
    """The catalog as text with bars, commas and quotes, read back and typed."""
    path = f"{shared_dir(v.spark)}/catalog-{uuid4().hex}"
    lists = {c: F.concat(F.lit(" "), F.array_join(c, " | "), F.lit("| ")) for c in ("alt_titles", "contained_titles")}
    v.derived("catalog").withColumns(lists | {"is_omnibus": F.when(F.col("is_omnibus"), "TRUE").otherwise("no"), "spine_hex": F.lower(F.replace("spine_hex", F.lit("#"), F.lit("##")))}).write.csv(path, header=True, escape='"')
    return flat(read_catalog(v.spark, path))


@query("catalog_replaced", f"{ctes('catalog')} {FLAT} from catalog where year % 2 = 0")
def _(v):
    """A second version in place of the first one."""
    path = f"{shared_dir(v.spark)}/versions-{uuid4().hex}"
    replace_catalog(v.derived("catalog"), path)
    replace_catalog(v.derived("catalog").where("year % 2 = 0"), path)
    return flat(current_catalog(v.spark, path))


@query("responses_read", f"{ALIGNED} select * from reads2")
def _(v):
    """Responses as compressed JSON lines, read back and aligned."""
    path = f"{shared_dir(v.spark)}/responses-{uuid4().hex}"
    write_responses(v.derived("responses"), path)
    return P.align_reads(read_responses(v.spark, path))


@query("detections_written", f"{ctes('detections')} select created_at::date as scan_date, status, count(*) as n, sum(detection_id)::bigint as ids, count(chosen_book) as chosen from detections group by 1, 2")
def _(v):
    """Detections by the date of the scan, in batches of which two were written before, read back."""
    path = f"{shared_dir(v.spark)}/detections-{uuid4().hex}"
    for some in ("detection_id % 3 = 0", "detection_id % 3 = 0", "true", "detection_id % 2 = 0"):
        write_detections(v.derived("detections").where(some), path)
    return v.spark.read.parquet(path).groupBy("scan_date", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("detection_id").alias("ids"), F.count("chosen_book").alias("chosen"))


# Reports and audits

@query("scan_summaries", f"""{ctes('detections')} select scan_id, count_if(status in ('auto_added', 'confirmed')) as added, count_if(status in ('needs_review', 'unmatched', 'unreadable', 'failed')) as review, count_if(status = 'auto_added') as auto_added, count_if(status = 'needs_review') as needs_review, count_if(status = 'unmatched') as unmatched,
  count_if(status = 'unreadable') as unreadable, count_if(status = 'failed') as failed, count_if(status = 'confirmed') as confirmed, count_if(status = 'discarded') as discarded from detections group by 1""")
def _(v):
    return R.scan_summary(v.derived("detections"))


@query("auto_rate", f"{ctes('detections')} select status, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from detections group by 1")
def _(v):
    return R.auto_rate(v.derived("detections")).withColumn("share", F.round("share", 6))


@query("stage_latency", "with t as (select event_type as stage, floor(value * 10)::int as ms from events union all select 'total', floor(value * 20)::int from events) select stage, median(ms)::double as median_ms, count(*) as n from t group by 1")
def _(v):
    timings = v.table("events").select(F.col("event_id").alias("scan_id"), F.create_map(F.col("event_type"), F.floor(F.col("value") * 10).cast("int"), F.lit("total"), F.floor(F.col("value") * 20).cast("int")).alias("timings"))
    return R.stage_latency(timings)


def usage(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_type").alias("model"), (F.col("event_id") % 900 + 424).alias("tokens_in"), (F.col("event_id") % 90).alias("tokens_out"), F.lit(426).alias("prompt_tokens"), (F.col("event_id") % 9 * 1082).alias("image_tokens"), (F.col("event_id") % 9 + 1).alias("n_crops"))


def rates(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_type").alias("model")).distinct().withColumn("rate_in", F.length("model") / 10).withColumn("rate_out", F.length("model") * 1.5)


COSTS = "with u as (select event_type as model, event_id % 900 + 424 as i, event_id % 90 as o from events), c as (select model, count(*) as scans, avg((i * (length(model) / 10) + o * (length(model) * 1.5::double)) / 1e6) as c from u group by 1)"


@query("scan_costs", f"{COSTS} select model, scans, round(c, 9) as cost_per_scan, round(c * 1000, 6) as cost_per_1000 from c")
def _(v):
    return R.scan_cost(usage(v), rates(v)).withColumn("cost_per_scan", F.round("cost_per_scan", 9)).withColumn("cost_per_1000", F.round("cost_per_1000", 6))


@query("cost_projection", f"{COSTS} select model, d::integer as scans_per_day, round(c * d * 30, 6) as monthly, round(c * d * 15, 6) as monthly_batch from c, (select unnest([100, 1000, 10000]) as d)")
def _(v):
    return R.cost_projection(R.scan_cost(usage(v), rates(v))).withColumn("monthly", F.round("monthly", 6)).withColumn("monthly_batch", F.round("monthly_batch", 6))


@query("batch_saving", "with u as (select event_id % 9 + 1 as n_crops, event_id % 9 * 1082 as i from events) select n_crops, sum(426 + i)::bigint as batched, sum(426 * n_crops + i)::bigint as single, round(1 - sum(426 + i) / sum(426 * n_crops + i), 6) as saving from u group by 1")
def _(v):
    return R.batch_saving(usage(v)).withColumn("saving", F.round("saving", 6))


@query("catalog_profile", f"{ctes('catalog')} select count(*) as n_rows, count_if(len(alt_titles) > 0) as with_alt, count_if(series <> '') as with_series, count_if(year is not null) as with_year, count_if(spine_color <> '') as with_color, count_if(is_omnibus) as omnibus from catalog")
def _(v):
    return R.catalog_profile(v.derived("catalog"))


@query("audit_shared_titles", f"{ctes('catalog')} select {norm('title')} as norm_title, count(distinct {surname('author')} || '/' || array_to_string({initials('author')}, ' ')) as n_authors, count(*) as n_rows from catalog group by 1 having n_authors > 1")
def _(v):
    return R.audit_shared_titles(v.derived("catalog"))


EDITIONS = "select p_partkey as book_id, p_name as title, p_brand as author, 1950 + p_size as year from part"


@query("audit_editions", f"with e as ({EDITIONS}) select {norm('title')} as norm_title, {surname('author')} as surname, array_to_string({initials('author')}, ' ') as initials, count(*) as n_rows, array_to_string(list_sort(list_distinct(list(year))), ',') as years from e group by 1, 2, 3 having count(*) > 1")
def _(v):
    return R.audit_editions(v.table("part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), (1950 + F.col("p_size")).alias("year")))


@query("audit_alt_titles", f"with c as (select p_partkey as book_id, p_name as title, 'The ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 2) as a from part), t as (select book_id as other_id, {norm('title')} as k from c union all select -1, 'ring ring') select book_id, a as alt_title, other_id from c join t on {norm('a')} = k where book_id <> other_id")
def _(v):
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    rows = v.table("part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("The "), second, F.lit(" "), second)).alias("alt_titles"))
    extra = v.table("region").select(F.lit(-1).cast("long").alias("book_id"), F.lit("ring ring").alias("title"), F.array().cast("array<string>").alias("alt_titles")).distinct()
    return R.audit_alt_titles(rows.unionAll(extra))


@query("audit_substring_titles", f"""with p as (select p_name as t from part union select p_type || ' ' || p_name from part union select split_part(p_name, ' ', 2) || ' ' || p_brand from part), t as (select distinct {norm('t')} as t from p),
  s as (select t, list_distinct(string_split(t, ' ')) as ws from t where t <> '') select a.t as title_in, b.t as title_of from s a join s b on len(a.ws) < len(b.ws) and list_has_all(b.ws, a.ws)""")
def _(v):
    part, kinds = v.table("part"), ("p_name", "concat(p_type, ' ', p_name)", "concat(split_part(p_name, ' ', 2), ' ', p_brand)")
    return R.audit_substring_titles(part.select(F.explode(F.array(*map(F.expr, kinds))).alias("title")))


@query("audit_author_variants", f"with c as (select case when p_partkey % 2 = 0 then p_brand else replace(p_brand, '#', '. ') end as author from part) select {surname('author')} as surname, array_to_string({initials('author')}, ' ') as initials, count(distinct author) as n_forms, array_to_string(list_sort(list_distinct(list(author))), '; ') as forms from c group by 1, 2 having count(distinct author) > 1")
def _(v):
    author = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit(". ")))
    return R.audit_author_variants(v.table("part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), author.alias("author")))


@query("check_hexes", "select p_partkey as book_id, substr(md5(p_name), 1, 6) as spine_hex from part where p_partkey % 3 = 0")
def _(v):
    hexes = F.substring(F.md5("p_name"), 1, 6)
    return R.check_hexes(v.table("part").select(F.col("p_partkey").alias("book_id"), F.when(F.col("p_partkey") % 3 == 0, hexes).otherwise(F.concat(F.lit("#"), F.upper(hexes))).alias("spine_hex")))


@query("catalog_coverage", f"""{ctes('catalog')}, e as (select title || case when book_id % 5 = 0 then ' lost' else '' end as title, case when book_id % 7 = 0 then 'Nobody' else author end as author, spine_color, spine_hex from catalog),
  j as (select e.title, c.author is not null as there, coalesce(c.author = e.author and c.spine_color = e.spine_color and c.spine_hex = e.spine_hex, false) as ok from e left join catalog c on {norm('c.title')} = {norm('e.title')})
  select title, case when bool_or(there) then 'differs' else 'missing' end as problem from j group by 1 having not bool_or(ok)""")
def _(v):
    catalog = v.derived("catalog")
    expected = catalog.withColumn("title", F.when(F.col("book_id") % 5 == 0, F.concat("title", F.lit(" lost"))).otherwise(F.col("title"))).withColumn("author", F.when(F.col("book_id") % 7 == 0, "Nobody").otherwise(F.col("author")))
    return R.catalog_coverage(expected.select("title", "author", "spine_color", "spine_hex"), catalog)
