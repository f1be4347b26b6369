"""Tables of the linkage jobs, derived from the given tables by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Views:
    """The given tables of a folder as views of a session, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        sql, tables = SPARK_VIEWS[name]
        return self.spark.sql(sql, **{t: self.dealt(t, DEALT.get(name)) for t in tables})

    def dealt(self, name: str, key: str | None) -> DataFrame:
        """A table, dealt by a key where one is given: into a fixed number of parts, which adaptive execution leaves alone."""
        if key is None:
            return self.table(name)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        return self.table(name).repartition(parts, key)


def spelled(text: str, first: int, n: int) -> str:
    """A word of ``n`` letters that ``text`` decides, in both dialects."""
    return f"translate(substr(md5({text}), {first}, {n}), '0123456789abcdef', 'kabemotirufselnd')"


#: A title of three words that tell it from others; some are second volumes, whose titles hold the first one's. And another title.
TITLE = f"concat(p_name, ' ', {spelled('p_name', 1, 5)}, case when {{size}} % 4 = 0 then ' II' else '' end)"
OTHER = f"concat('The ', {spelled('p_name', 6, 5)}, ' ', {spelled('p_name', 11, 5)}, ' ', {spelled('p_name', 16, 4)})"
SURNAME, GIVEN, SECOND = spelled("p_brand", 1, 7), spelled("p_brand", 9, 1), spelled("p_brand", 10, 1)
#: A row per book: products by name and brand. Brands are authors, whose names come in several forms, one a letter off, some not at all.
CATALOG = f"""select min(p_partkey) as book_id, {TITLE.format(size='min(p_size)')} as title,
    case when min(p_partkey) % 11 = 0 then '' when min(p_partkey) % 5 = 0 then concat({SURNAME}, ', ', {GIVEN}, '.') when min(p_partkey) % 5 = 1 then concat({GIVEN}, '. ', {SURNAME}, 's')
         when min(p_partkey) % 5 = 2 then concat({GIVEN}, '.', {SECOND}, '. ', {SURNAME}) else concat({GIVEN}, '. ', {SURNAME}) end as author,
    array({OTHER}) as alt_titles, 1950 + min(p_size) as year,
    case when min(p_size) % 3 = 0 then concat('Series ', cast(min(p_size) as string)) else '' end as series,
    min(p_size) % 10 = 0 as is_omnibus, array({TITLE.format(size='1')}, concat('old ', split_part(p_name, ' ', 2))) as contained_titles,
    split_part(p_name, ' ', 1) as spine_color, concat('#', upper(substr(md5(p_name), 1, 6))) as spine_hex
  from {{part}} group by p_name, p_brand"""
#: A row per read: orders see the product that has their customer's number, well or badly.
READS = f"""select o_orderkey as read_id, o_orderkey div 8 as scan_id, cast(o_orderkey % 8 + 1 as int) as slot,
    case when o_orderkey % 12 = 6 then {OTHER} when o_orderkey % 6 = 2 then concat(substr(p_name, 1, 1), substr({TITLE.format(size='p_size')}, 3)) when o_orderkey % 6 = 4 then concat('Zyxw ', o_orderpriority) when o_orderkey % 6 = 5 then concat(' ', chr(9), chr(160)) else {TITLE.format(size='p_size')} end as title,
    case when o_orderkey % 6 = 1 then null when o_orderkey % 6 = 3 then 'Nobody Else' when o_orderkey % 4 = 0 then concat({SURNAME}, ', ', {GIVEN}) else concat({GIVEN}, '. ', {SURNAME}) end as author,
    split_part(p_name, ' ', 1) as spine_color, o_orderkey % 31 = 0 as not_a_book,
    case when o_orderkey % 37 = 0 then 'duplicate' when o_orderkey % 41 = 0 then 'failed' when o_orderkey % 43 = 0 then 'unreadable' when o_orderkey % 31 = 0 and o_orderkey % 2 = 0 then 'not_a_book' else 'ok' end as status,
    o_orderkey % 41 <> 0 and o_orderkey % 43 <> 0 and o_orderkey % 37 <> 0 and (o_orderkey % 31 <> 0 or o_orderkey % 2 <> 0) as readable
  from {{orders}} join {{part}} on p_partkey = o_custkey"""
BOXES = """select l_orderkey as scan_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as ord,
    case when l_linenumber = 7 then 'vase' else 'book' end as cls, cast(1 - 8 * l_discount as double) as conf,
    cast(l_partkey % 40 * 40 as double) as x1, cast(l_suppkey % 20 * 10 as double) as y1,
    cast(l_partkey % 40 * 40 + 20 + l_quantity * 4 as double) as x2, cast(l_suppkey % 20 * 10 + 100 + l_linenumber * 90 as double) as y2,
    2000 as image_width, 900 as image_height
  from {lineitem}"""
DETECTIONS = """select event_id as detection_id, event_id div 6 as scan_id, cast(event_id % 6 as int) as slot,
    element_at(array('auto_added', 'needs_review', 'unmatched', 'unreadable', 'failed', 'confirmed', 'discarded'), cast((event_id * 3 + user_id) % 7 + 1 as int)) as status,
    case when (event_id * 3 + user_id) % 7 in (0, 5) then event_id % 200 end as chosen_book, ts as created_at
  from {events}"""
ACTIONS = """select event_id as action_id, event_id div 3 as detection_id,
    element_at(array('confirm', 'discard', 'retry', 'confirm'), cast(user_id % 4 + 1 as int)) as action,
    case when event_id % 5 > 0 then event_id % 3000 end as book_id,
    case when event_id % 10 = 0 then concat('Own ', cast(event_id as string)) when event_id % 15 = 0 then concat(' ', chr(9)) end as custom_title,
    cast(null as string) as custom_author, event_id % 2 = 0 as has_crop, ts
  from {events}"""
LIBRARY = """select event_id as entry_id, case when event_id % 11 > 0 then event_id % 2500 end as book_id,
    case when event_id % 22 = 0 then concat('Own ', cast(event_id as string)) else '' end as custom_title, '' as custom_author,
    event_id * 2 as source_detection_id, ts as created_at
  from {events}"""
#: Runs of edge points: a column of each product's box, from its top down.
EDGES = """select l_orderkey as scan_id, cast(l_partkey % 40 * 40 + 12 as int) as x, cast(min(l_suppkey % 20 * 10) as int) as y1, cast(max(l_suppkey % 20 * 10 + 30 * l_linenumber + l_quantity * 4) as int) as y2
  from {lineitem} group by l_orderkey, cast(l_partkey % 40 * 40 + 12 as int)"""
#: Raw model text of each order's lines: fenced, wrapped in prose, with a remark in brackets, broken off, with repeated keys or what is no number, by key.
RESPONSES = """select l_orderkey as scan_id, cast(count(*) + 1 as int) as n_crops, l_orderkey % 19 = 0 as call_failed, l_orderkey % 51 = 0 as repair_failed,
    case when l_orderkey % 17 = 0 then concat('[', array_join(transform(array_sort(collect_list(struct(n, item))), x -> x.item), ','))
         when l_orderkey % 3 = 0 then concat('```json [', array_join(transform(array_sort(collect_list(struct(n, item))), x -> x.item), ','), '] ```')
         when l_orderkey % 23 = 0 then concat('Read: [', array_join(transform(array_sort(collect_list(struct(n, item))), x -> x.item), ','), '] with a note [1]')
         else concat('Here: [', array_join(transform(array_sort(collect_list(struct(n, item))), x -> x.item), ','), '] done') end as raw_text,
    case when l_orderkey % 34 = 0 or l_orderkey % 46 = 0 then concat('[', array_join(transform(array_sort(collect_list(struct(n, item))), x -> x.item), ','), ']') else 'sorry' end as repair_text
  from (select *, concat('{{"index": ', cast(n as string), ', "edition": ', case when l_suppkey % 9 = 0 then 'NaN' when l_suppkey % 9 = 1 then '-Infinity' else '"NaN"' end, case when l_partkey % 29 = 0 then ', "title": "Draft"' else '' end, ', "title": "', case when l_partkey % 13 = 0 then '' else concat('Title ', cast(l_partkey as string)) end,
      '", "author": ', case when l_suppkey % 4 = 0 then 'null' else concat('"Author ', cast(l_suppkey as string), '"') end,
      ', "readable": ', case when l_partkey % 11 = 0 then 'false' when l_partkey % 31 = 0 then 'NaN' else 'true' end, ', "spine_color": "', case when l_linenumber % 3 = 0 then 'pale Navy' else 'wooden' end,
      '", "not_a_book": ', case when l_partkey % 5 = 0 then 'true' else 'false' end, ', "duplicate_of": ', case when l_suppkey % 7 = 0 then '1' else 'null' end, '}}') as item
    from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from {lineitem}))
  group by l_orderkey"""

SPARK_VIEWS = {
    "catalog": (CATALOG, ["part"]),
    "reads": (READS, ["orders", "part"]),
    "boxes": (BOXES, ["lineitem"]),
    "edges": (EDGES, ["lineitem"]),
    "detections": (DETECTIONS, ["events"]),
    "actions": (ACTIONS, ["events"]),
    "library": (LIBRARY, ["events"]),
    "responses": (RESPONSES, ["lineitem"]),
}

#: Keys by which the input of a table is dealt beforehand. A few compressed bytes of a line make hundreds of text, which is parsed in
#: the same tasks: parts merged by their bytes are a few more than there are cores, so that most cores wait for the last ones.
DEALT = {"responses": "l_orderkey"}


def duck(sql: str) -> str:
    """The same rule as DuckDB writes it."""
    for t in ("part", "orders", "lineitem", "events"):
        sql = sql.replace(f"{{{t}}}", t)
    sql = sql.replace("{{", "{").replace("}}", "}").replace(" div ", " // ").replace("array(", "list_value(").replace("element_at(", "list_extract(").replace("as string)", "as varchar)")
    return sql.replace("array_join(transform(array_sort(collect_list(struct(n, item))), x -> x.item), ',')", "string_agg(item, ',' order by n)")


def ctes(*names: str) -> str:
    """``with`` clauses of derived tables, for a query in SQL."""
    return "with " + ", ".join(f"{n} as ({duck(SPARK_VIEWS[n][0])})" for n in names)
