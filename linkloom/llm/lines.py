"""Fuzzy line dedup by a deletion-neighbourhood join, on built-in functions alone.

The unit of an edit is a word: two lines are near when one word is replaced, inserted or left
out (any change inside a word is one edit). Deleting one word from each of two near lines, or
from the longer one only, gives equal word lists, so near lines share a *variant*. A line goes
if an earlier line, by (doc_id, line number), is equal or near; the earliest stays.

1. Equal lines are collapsed by a 128-bit hash. What follows sees each distinct line once.
2. One edit leaves one half of a line untouched. Only lines that share a half (with the length
   it belongs to) with another line go on; this loses no pair.
3. These emit their variants as hashed keys: the line itself and the line without each word.
   Keys are XORs of position-dependent word hashes, so all variants of a line come from two
   running XORs, in time linear in the line.
4. Equal variants are joined as groups, never as pairs: lines of a group that lost the same
   place are near to one another, and all are near to the line that *is* the variant. Each
   line is compared with the least of these only.
5. The edit distance of each such pair is verified on the words themselves.

Lines without a word (or of fewer than ``min_words``) stay; lines of fewer than ``fuzzy_words`` words go by
equality only, since one edit would change too much of them.

Defined cases: null texts stay null, empty lines stay; rows that repeat whole count as one
document and share its fate; rows that share a doc_id are ordered by a hash of the row; rows
without a doc_id come before all others and are ordered likewise; an empty table gives an empty
result; all columns of the input are kept, whatever their names, but for one named
``lines_report``, which ``without_lines`` replaces (``cut_lines`` keeps it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.shared import WORD_GAP, held, known_id, plain, table, written

MIN_WORDS, FUZZY_WORDS = 1, 8


def row_hash(docs: DataFrame) -> Column:
    """Tells rows apart by all they hold."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def words_in(line: Column) -> Column:
    """The words of a line that isn't blank; a blank one gives a single empty word."""
    return F.split(F.trim(line, F.lit(" \t\n\x0b\f\r")), WORD_GAP)


def lines_of(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row, line_no, line, words) of every line with enough words. Lines are sifted within the row, so each is split once."""
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), words_in(x).alias("words")))
    kept = F.filter(every, lambda x: (F.size(x["words"]) >= min_words) & (F.get(x["words"], F.lit(0)) != ""))
    return rows.select("doc_id", "row", F.explode(kept).alias("x")).select("doc_id", "row", "x.line_no", "x.line", "x.words")


def half_keys(words: Column, n: Column) -> list[Column]:
    """Hashes of both halves of a line, as a line of ``n`` words and as one of ``n - 1`` with a word more."""

    def halves(length: Column) -> list[Column]:
        at = F.floor(length / 2).cast("int")
        return [F.xxhash64(length, F.lit(1), F.slice(words, 1, at)), F.xxhash64(length, F.lit(2), F.slice(words, n - (length - at) + 1, length - at))]

    return [*halves(n), *halves(n - 1)]


PLACE = ["doc_id", "row", "line_no"]
HALVES = ["half1", "half2", "half3", "half4"]


def repeated_lines(rows: DataFrame, min_words: int, fuzzy_words: int) -> DataFrame:
    """(doc_id, row, line_no) of the lines that go. ``rows``: doc_id, text and ``row``."""
    n = F.size("words")
    halves = [F.when(n >= fuzzy_words, h).alias(c) for h, c in zip(half_keys(F.col("words"), n), HALVES, strict=True)]
    every = lines_of(rows, min_words).select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), *halves)
    every = written(every, "lines")
    # The earliest place of each distinct line.
    first = every.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("times"), *[F.min(c).alias(c) for c in HALVES])
    first = written(first, "first")
    again = every.select(*PLACE, "h1", "h2").join(first.where("times > 1").select("h1", "h2", "first"), ["h1", "h2"]).where(F.struct(*PLACE) != F.col("first")).select(*PLACE)

    # Distinct lines that share a half with another. A line's own four keys differ, so a key that comes twice is shared.
    half = first.where("half1 is not null").select("h1", F.explode(F.array(*HALVES)).alias("half"))
    both = half.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half")
    shared = half.join(both, "half").select("h1").distinct()
    near = first.select("h1", "first").join(shared, "h1").select("first.*")

    # Their words, in the documents where they stand first.
    wanted = near.groupBy(F.col("doc_id").alias("w_doc"), F.col("row").alias("w_row")).agg(F.collect_set("line_no").alias("numbers"))
    at = rows.join(wanted, (F.col("doc_id") == F.col("w_doc")) & (F.col("row") == F.col("w_row"))).dropDuplicates(["doc_id", "row"])
    split = F.split("text", "\n", -1)
    texts = at.select("doc_id", "row", F.explode("numbers").alias("line_no"), split.alias("split")).select(*PLACE, F.element_at("split", F.col("line_no") + 1).alias("line"))
    lines = written(texts.select(F.struct(*PLACE).alias("place"), words_in(F.col("line")).alias("words")), "near-lines")

    # Variants: (key, length, place left out), 0 for none.
    word = lines.select("place", F.posexplode("words").alias("i", "word")).withColumn("own", F.xxhash64("word", "i")).withColumn("moved", F.xxhash64("word", F.col("i") - 1))
    up_to = W.partitionBy("place").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("place")
    run = word.select("place", "i", "own", F.expr("bit_xor(own)").over(up_to).alias("before"), F.expr("bit_xor(moved)").over(up_to).alias("passed"), F.expr("bit_xor(moved)").over(whole).alias("all_moved"), F.expr("bit_xor(own)").over(whole).alias("all_own"), F.count(F.lit(1)).over(whole).alias("n"))
    without = F.col("before").bitwiseXOR(F.col("own")).bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("passed"))
    left_out = F.struct(without.alias("key"), (F.col("n") - 1).alias("length"), (F.col("i") + 1).alias("out"))
    itself = F.struct(F.col("all_own").alias("key"), F.col("n").alias("length"), F.lit(0).alias("out"))
    variants = run.select("place", F.explode(F.when(F.col("i") == 0, F.array(left_out, itself)).otherwise(F.array(left_out))).alias("v")).select("place", "v.*")
    # Most variants are nobody else's; only the others are compared.
    twice = variants.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("key")
    variants = written(variants.join(twice, "key"), "variants")

    same_out = variants.groupBy("key", "length", "out").agg(F.min("place").alias("least"), F.max("place").alias("most"))
    is_it = F.when(F.col("out") == 0, F.col("least"))
    by_key = same_out.groupBy("key", "length").agg(F.min(is_it).alias("itself"), F.min(F.when(F.col("out") > 0, F.col("least"))).alias("shortened"), F.count(F.lit(1)).alias("kinds"))
    group = same_out.join(by_key.where("itself is not null and kinds > 1").drop("kinds"), ["key", "length"], "left")
    target = F.when(F.col("out") == 0, F.least("itself", "shortened")).otherwise(F.least("least", "itself"))
    group = group.withColumn("target", F.coalesce(target, "least")).where((F.col("least") != F.col("most")) | (F.col("target") != F.col("least")) | (F.col("itself").isNotNull() & (F.col("out") == 0)))
    pairs = variants.join(group.select("key", "length", "out", "target"), ["key", "length", "out"]).where(F.col("place") > F.col("target")).select("place", "target").distinct()

    theirs = lines.select(F.col("place").alias("target"), F.col("words").alias("others"))
    verified = pairs.join(lines, "place").join(theirs, "target").where(one_edit(F.col("words"), F.col("others")))
    goes = verified.select("place").distinct().select("place.*")
    # All places of a line that goes: its first place, and those that repeat it go as repeats anyway.
    return again.unionAll(goes).distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Is the word edit distance of two lists at most 1?

    The lists agree up to the first difference; behind it they must agree again, one word further
    on in both, or in the longer one.
    """
    n, m = F.size(a), F.size(b)
    least = F.least(n, m)
    differs = F.filter(F.sequence(F.lit(1), least), lambda i: F.element_at(a, i) != F.element_at(b, i))
    at = F.coalesce(F.get(differs, 0), least + 1)
    rest = lambda x, size, start: F.slice(x, start, F.greatest(F.lit(0), size - start + 1))
    return F.when(n == m, rest(a, n, at + 1) == rest(b, m, at + 1)).when(n == m + 1, rest(a, n, at + 1) == rest(b, m, at)).when(m == n + 1, rest(a, n, at) == rest(b, m, at + 1)).otherwise(False)


def without_lines(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; and ``n_lines``, ``n_removed`` in a struct ``lines_report``."""
    found = cut_lines(docs, min_words, fuzzy_words)
    return found.select(*[F.col(f"d.`{c}`") for c in docs.columns if c != "lines_report"], "lines_report")


def cut_lines(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """The same as two structs: ``d``, a row of ``docs`` as it becomes, and ``lines_report``."""
    rows = docs.select(held(docs), row_hash(docs).alias("row"))
    # The hash of the row tells a missing id from one that equals its stand-in.
    cuts = repeated_lines(rows.select(known_id(F.col("d.doc_id")).alias("doc_id"), "d.text", "row"), min_words, fuzzy_words)
    cuts = cuts.groupBy(F.col("doc_id").alias("cut_doc"), F.col("row").alias("cut_row")).agg(F.collect_set("line_no").alias("cut_lines"))
    joined = rows.join(cuts, (known_id(F.col("d.doc_id")) == F.col("cut_doc")) & (F.col("row") == F.col("cut_row")), "left")
    # The split lines are a column of their own: within a function of lines they would be split again for each line.
    joined = joined.withColumn("split", F.split("d.text", "\n", -1))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("cut_lines"))
    kept = F.array_join(F.transform(numbers, lambda i: F.get("split", i)), "\n")
    text = F.when(F.col("cut_lines").isNull(), F.col("d.text")).otherwise(kept)
    n_lines = F.when(F.col("d.text").isNull(), F.lit(0)).otherwise(F.size("split"))
    report = F.struct(n_lines.alias("n_lines"), F.when(F.col("cut_lines").isNull(), F.lit(0)).otherwise(F.size("cut_lines")).alias("n_removed"))
    row = F.struct(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns])
    return joined.select(row.alias("d"), report.alias("lines_report"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and what is left of its text, as length and hash."""
    docs = plain(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    found = without_lines(docs)
    return found.select("doc_id", F.col("lines_report.n_lines").cast("long").alias("n_lines"), F.col("lines_report.n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP2_SQL = r"""
with split as (select doc_id, string_split(text, chr(10)) as ls from documents),
lines as (select doc_id, unnest(range(0, len(ls))) as no, unnest(ls) as line from split),
w as (select *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from lines),
e as (select *, doc_id * 1000000 + no as place from w where len(ws) >= 1),
f as (select line, any_value(ws) as ws, min(place) as first from e group by line),
v as (
  select first, 0 as out, array_to_string(ws, ' ') as key from f where len(ws) >= 8
  union all
  select first, i as out, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') from (select first, ws, unnest(range(1, len(ws) + 1)) as i from f where len(ws) >= 8)
),
near as (select distinct a.first from v a join v b on a.key = b.key and b.first < a.first and (a.out = b.out or a.out = 0 or b.out = 0)),
gone as (select place from e join f using (line) where place > first union select first from near),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.no) as t, count(*) as n from lines l where l.doc_id * 1000000 + l.no not in (select place from gone) group by 1)
select s.doc_id, len(s.ls)::bigint as n_lines, len(s.ls)::bigint - coalesce(k.n, 0) as n_removed, length(coalesce(k.t, ''))::bigint as kept_chars, md5(coalesce(k.t, '')) as kept_md5
from split s left join kept k using (doc_id)
"""
