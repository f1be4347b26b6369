"""Matching reads against a catalog: scores, the best candidates, the decision.

Equal reads are scored once, and so is each distinct pair of a read's and a book's title. Both sides
are dealt by title into blocks of bounded size, a title with very many rows into several; a block of
reads meets a block of titles in a tile, which scores the titles, combines them with authors, and
returns the few best books of each read. Pairs are never emitted, and neither side is broadcast. The
blocked mode lets only rows meet that can decide an automatic match, by joins on surnames; the review
mode does so first, and gives all reads that don't match their candidates from the whole catalog.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.config import MATCH, MatchConfig
from linkloom.functions.bounds import counted, weighted_bounds
from linkloom.functions.fuzzy import Tokens, indel_ratio, lengths, numbered, ratios, weighted_ratios
from linkloom.functions.text import normalize_author, normalize_text, strip
from linkloom.tables import written

#: Different titles of a block of reads and of a block of books, and the rows of either.
READ_TITLES, BOOK_TITLES, ROWS = 256, 1024, 8192
#: Parts that tiles are dealt into, at most.
MOST_PARTS = 20_000
#: Pairs of titles that are scored at a time, and scores of reads with books that are looked at at a time.
PAIRS, SCORES = 100_000, 2_000_000


@dataclass(frozen=True)
class Prepared:
    """A catalog and its keys, made once for any number of matches."""

    catalog: DataFrame
    keys: DataFrame


def prepare(catalog: DataFrame, config: MatchConfig = MATCH) -> Prepared:
    """Keys: (book_id, book_title, row_name), a row for each different normalised title of a book, '' if it has none.

    Books that agree in title and author score alike; of these only the first few ids can be candidates.
    """
    every = F.concat(F.array("title"), F.coalesce("alt_titles", F.array().cast("array<string>")))
    # Titles are normalised as rows of their own, so a Python function sees plain strings.
    rows = catalog.select("book_id", "author", F.posexplode(every).alias("at", "t")).withColumn("t", normalize_text(F.col("t")))
    rows = rows.where("at = 0 or t <> ''").groupBy("book_id", "author").agg(F.collect_set("t").alias("titles"))
    named = F.when(F.size(F.array_remove("titles", "")) > 0, F.array_remove("titles", "")).otherwise(F.array(F.lit("")))
    rows = rows.select("book_id", normalize_author(F.col("author")).alias("row_name"), F.explode(named).alias("book_title"))
    alike = F.row_number().over(W.partitionBy("book_title", "row_name").orderBy("book_id"))
    keys = rows.withColumn("alike", alike).where(F.col("alike") <= max(2, config.candidates)).drop("alike")
    return Prepared(catalog, written(keys, "catalog-keys"))


def author_score(a: Column, b: Column, surname_ratio: Column, config: MatchConfig = MATCH) -> Column:
    """Likeness of two parsed names; null if one is unknown. ``surname_ratio`` counts for unequal surnames."""
    base = F.when(a["surname"] == b["surname"], F.lit(1.0)).otherwise(surname_ratio)
    k = F.least(F.size(a["initials"]), F.size(b["initials"]))
    same = F.slice(a["initials"], F.lit(1), k) == F.slice(b["initials"], F.lit(1), k)
    score = F.when(base < config.surname_threshold, F.lit(0.0)).when((k == 0) | same, base).otherwise(base * 0.5)
    return F.when(a.isNotNull() & b.isNotNull(), score)


def blend(title: Column, author: Column, config: MatchConfig = MATCH) -> Column:
    """One score of both; without an author it is capped."""
    return F.when(author.isNull(), F.least(title, F.lit(config.no_author_cap))).otherwise(config.title_weight * title + config.author_weight * author)


def names(column: pa.ChunkedArray) -> list[tuple[str, tuple] | None]:
    return [None if n is None else (n["surname"], tuple(n["initials"])) for n in column.to_pylist()]


def near_pairs(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and ratios of all pairs of different surnames whose ratio reaches the threshold; equal ones have 1.

    Of m and n letters, L >= threshold (m + n) / 2 are common in order, with at most m + n - 2 L places where the
    order breaks; so at least L - 1 - (m + n - 2 L) pairs of adjacent letters are common, counted as often as
    both have them. Pairs are found by the letter pairs of ``b``, so only they are ever held.
    """
    postings: dict[tuple, list[int]] = {}
    for j, y in enumerate(b):
        for g in counted(y[k : k + 2] for k in range(len(y) - 1)):
            postings.setdefault(g, []).append(j)
    arrays = {g: np.asarray(js, np.int64) for g, js in postings.items()}
    place, lb, out = {y: j for j, y in enumerate(b)}, lengths(b), []
    left, right, held = [], [], 0

    def settled() -> None:
        if not left:
            return
        i, j = np.concatenate(left), np.concatenate(right)
        found = ratios([a[x] for x in i], [b[y] for y in j]) / 100
        near = found >= threshold
        out.append((i[near], j[near], found[near]))
        left.clear()
        right.clear()

    for i, x in enumerate(a):
        if x in place:
            out.append((np.array([i]), np.array([place[x]]), np.ones(1)))
        met = [arrays[g] for g in counted(x[k : k + 2] for k in range(len(x) - 1)) if g in arrays]
        if met:
            j, times = np.unique(np.concatenate(met), return_counts=True)
            total = lb[j] + len(x)
            least = np.ceil(threshold * total / 2 - 1e-9)
            close = (np.minimum(lb[j], len(x)) >= least) & (times >= 3 * least - total - 1)
            j = j[close]
            j = j[j != place.get(x, -1)]
            if len(j):
                left.append(np.full(len(j), i))
                right.append(j)
                held += len(j)
        if held >= PAIRS:
            settled()
            held = 0
    settled()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class AuthorScores:
    """Author scores of reads' names with books' names, as rows when they are asked for: most are 0, and only near surnames are held."""

    def __init__(self, reads: list[tuple | None], books: list[tuple | None], config: MatchConfig) -> None:
        self.reads, self.books = reads, books
        self.known = np.array([n is not None for n in books], bool)
        mine, (self.of_read,) = numbered([n[0] if n else "" for n in reads])
        theirs, (of_book,) = numbered([n[0] if n else "" for n in books])
        i, j, score = near_pairs(mine, theirs, config.surname_threshold)
        order = np.argsort(i, kind="stable")
        self.j, self.score = j[order], score[order]
        self.cuts = np.searchsorted(i[order], np.arange(len(mine) + 1))
        self.by_surname = np.argsort(of_book, kind="stable")
        self.surname_cuts = np.searchsorted(of_book[self.by_surname], np.arange(len(theirs) + 1))
        wide = max([1, *(len(n[1]) for n in books if n)])
        self.initials = np.full((len(books), wide), "", dtype="U2")
        for row, n in zip(self.initials, books, strict=True):
            row[: len(n[1]) if n else 0] = n[1] if n else ()
        self.sizes = np.fromiter((len(n[1]) if n else 0 for n in books), np.int64, len(books))

    def row(self, read: int) -> np.ndarray:
        """Scores with each book's name, NaN where either is unknown."""
        if self.reads[read] is None:
            return np.full(len(self.books), math.nan)
        out = np.where(self.known, 0.0, math.nan)
        own = self.reads[read][1]
        at = self.of_read[read]
        for j, score in zip(self.j[self.cuts[at] : self.cuts[at + 1]], self.score[self.cuts[at] : self.cuts[at + 1]], strict=True):
            books = self.by_surname[self.surname_cuts[j] : self.surname_cuts[j + 1]]
            books = books[self.known[books]]
            common, same = np.minimum(self.sizes[books], len(own)), np.ones(len(books), bool)
            for k, letter in enumerate(own[: self.initials.shape[1]]):
                same &= (k >= common) | (self.initials[books, k] == letter)
            out[books] = np.where((common == 0) | same, score, score * 0.5)
        return out


#: What is shown of a candidate.
SHOWN = ("title", "author", "year", "series", "spine_color", "spine_hex")
SCORED = "read_key binary, book_id long, title_score double, author_score double, score double"
SCORED_TYPES = pa.schema([("read_key", pa.binary()), ("book_id", pa.int64()), ("title_score", pa.float64()), ("author_score", pa.float64()), ("score", pa.float64())])


def kth_best(score: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th best score; -1 where there are fewer."""
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] >= k else np.full(len(score), -1.0)


def kth_column(score: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """The column of the k-th best score, which is ``value``, ties to the first."""
    above = (score > value[:, None]).sum(axis=1)
    return (np.cumsum(score == value[:, None], axis=1) == (k - above)[:, None]).argmax(axis=1)


#: So many rows of the highest bounds are scored for each read, before the others are looked at.
FIRST = (6, 30, 100)
#: Cells of reads and rows to a pair of titles, from which all pairs are scored.
MANY = 8


def tile(config: MatchConfig, scorer: str, scored: Accumulator | None = None):
    """The best books of one block for each read of another. Each pair of different titles is scored once, or not at all.

    A pair is scored only if its bound says that it could bring a book among a read's best: the bound
    is blended with the authors' score and held against the worst of the best so far. The best are therefore those of
    all pairs. ``scored`` counts the pairs that are.
    """
    n_best = max(2, config.candidates)

    def blended(t: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(a), np.minimum(t, config.no_author_cap), config.title_weight * t + config.author_weight * np.nan_to_num(a))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SCORED_TYPES.empty_table()
        right = right.sort_by("book_id")
        books, first, book_of_row = np.unique(right["book_id"].to_numpy(), return_index=True, return_inverse=True)
        mine, (of_read,) = numbered(left["norm_title"].to_pylist())
        theirs, (of_row,) = numbered(right["book_title"].to_pylist())
        read_names, (name_of_read,) = numbered(names(left["name"]))
        book_names, (name_of_book,) = numbered(names(right["row_name"].take(pa.array(first))))
        authors = AuthorScores(read_names, book_names, config)
        bound = np.where(np.array([bool(x) for x in mine])[:, None] & np.array([bool(x) for x in theirs])[None, :], weighted_bounds(mine, theirs), 0.0)
        exact, done, tokens = np.zeros(bound.shape), bound == 0, Tokens()
        step = max(1, SCORES // len(of_row))

        def chunks():
            for at in range(0, left.num_rows, step):
                of, who = of_read[at : at + step], name_of_read[at : at + step]
                some, place = np.unique(who, return_inverse=True)
                yield at, of, np.stack([authors.row(x) for x in some])[place][:, name_of_book]

        def score(pairs: np.ndarray) -> None:
            rows, cols = np.nonzero(pairs & ~done)
            for at in range(0, len(rows), PAIRS):
                i, j = rows[at : at + PAIRS], cols[at : at + PAIRS]
                x, y = [mine[k] for k in i], [theirs[k] for k in j]
                exact[i, j] = (ratios(x, y) if scorer == "ratio" else weighted_ratios(x, y, tokens)) / 100
            done[rows, cols] = True
            if scored is not None:
                scored.add(len(rows))

        def needed(most_rows: int | None = None) -> np.ndarray:
            """Pairs of titles that could still bring a book of a read among its best; of each read, if so asked, those of the highest bounds."""
            out = np.zeros(bound.shape, bool)
            for _, of, by in chunks():
                found = blended(np.maximum.reduceat(exact[of][:, of_row], first, axis=1), by)
                worst = kth_best(found, n_best)
                most = blended(bound[of][:, of_row], by[:, book_of_row])
                least = worst if most_rows is None else np.maximum(worst, kth_best(most, min(most_rows, most.shape[1])))
                rows, cols = np.nonzero((most >= least[:, None]) & ~done[of][:, of_row])
                # A bound that ties, as capped ones do, counts for a smaller id than that of the worst.
                tied = np.flatnonzero(most[rows, cols] == worst[rows])
                if len(tied) and found.shape[1] >= n_best:
                    some, place = np.unique(rows[tied], return_inverse=True)
                    late = tied[book_of_row[cols[tied]] > kth_column(found[some], worst[some], n_best)[place]]
                    rows, cols = np.delete(rows, late), np.delete(cols, late)
                out[of[rows], of_row[cols]] = True
            return out

        # Where many reads share a title, to look at every read costs more than to score every pair.
        if left.num_rows * len(of_row) > MANY * bound.size:
            score(~done)
        for n in (*FIRST, None):
            if not done.all():
                score(needed(n))
        keys, out = left["read_key"], []
        for at, of, by in chunks():
            title = np.maximum.reduceat(exact[of][:, of_row], first, axis=1)
            found = blended(title, by)
            n = found.shape[1]
            floor = np.partition(found, n - n_best, axis=1)[:, n - n_best] if n > n_best else np.full(len(found), -1.0)
            rows, cols = np.nonzero(found >= floor[:, None])
            order = np.lexsort((cols, -found[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < n_best
            rows, cols = rows[best], cols[best]
            author = by[rows, cols]
            out.append(pa.table([keys.take(pa.array(rows + at)).combine_chunks(), pa.array(books[cols]), pa.array(title[rows, cols]), pa.array(author, mask=np.isnan(author)), pa.array(found[rows, cols])], schema=SCORED_TYPES))
        return pa.concat_tables(out)

    return run


def spelled(reads: DataFrame) -> DataFrame:
    """(title, author, norm_title, name, read_key): the different spellings of reads with a title that isn't blank."""
    raw = reads.select("title", "author").where(strip(F.col("title")) != "").distinct()
    keyed = raw.withColumn("norm_title", normalize_text(F.col("title"))).withColumn("name", normalize_author(F.col("author")))
    # 128 bits, so that two reads of even the largest table don't share a key.
    return keyed.withColumn("read_key", F.unhex(F.md5(F.to_json(F.struct("norm_title", "name")))))


def distinct_reads(reads: DataFrame) -> DataFrame:
    """(read_key, norm_title, name): the different reads that need scoring. Blank titles aren't among them."""
    return spelled(reads).select("norm_title", "name", "read_key").distinct()


def dealt(df: DataFrame, title: str, row: str, titles: int, least: int = 1) -> tuple[DataFrame, int]:
    """Adds ``block``, by title; a title with more than an eighth of a block's rows is spread over several. And the number of blocks."""
    part = max(1, ROWS // 8)
    counts = df.groupBy(title).agg(F.count(F.lit(1)).alias("n"))
    n_titles, n_rows = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = max(least, math.ceil(n_titles / titles), math.ceil((n_rows or 0) / ROWS))
    hot = counts.where(F.col("n") > part).select(F.col(title).alias("hot_title"), F.ceil(F.col("n") / part).alias("shares"))
    share = F.pmod(F.xxhash64(row), F.coalesce("shares", F.lit(1)))
    out = df.join(hot, F.col(title) == F.col("hot_title"), "left").withColumn("block", F.pmod(F.xxhash64(title, share), F.lit(blocks)).cast("int"))
    return out.drop("hot_title", "shares"), blocks


def score_exact(reads: DataFrame, catalog: DataFrame | Prepared, config: MatchConfig = MATCH, scorer: str = "wratio", scored: Accumulator | None = None) -> DataFrame:
    """The best candidates of each distinct read, from all rows of the catalog. Both sides should be tables, not plans: they are read several times."""
    keys = (catalog if isinstance(catalog, Prepared) else prepare(catalog, config)).keys
    right, blocks = dealt(keys, "book_title", "book_id", BOOK_TITLES)
    # A small catalog still gives all cores a tile.
    cores = reads.sparkSession.sparkContext.defaultParallelism
    least = min(max(1, cores // blocks), max(1, reads.limit(16 * cores).count() // 16))
    left, read_blocks = dealt(reads, "norm_title", "read_key", READ_TITLES, least)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("read_key", "norm_title", "name", F.col("block").alias("rb"), every(blocks).alias("cb"))
    right = right.select("book_id", "book_title", "row_name", F.col("block").alias("cb2"), every(read_blocks).alias("rb2"))
    # A tile is little to send and much to compute: as many parts as tiles, which the engine would merge by their size otherwise.
    parts = min(blocks * read_blocks, MOST_PARTS)
    return left.repartition(parts, "rb", "cb").groupBy("rb", "cb").cogroup(right.repartition(parts, "rb2", "cb2").groupBy("rb2", "cb2")).applyInArrow(tile(config, scorer, scored), SCORED)


def near_surnames(a: DataFrame, b: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """(x, y): equal surnames, and those whose ratio reaches the threshold; ``a`` and ``b`` hold different surnames x and y."""
    # Unequal surnames at 0.85 or more have a longest common subsequence L >= 0.425 (m + n), and at most
    # m + n - 2 L places where it breaks; L - 1 exceeds that, so a pair of adjacent letters is common.
    low = config.surname_threshold / (2 - config.surname_threshold)
    pairs_of = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).alias("g")
    # Letter pairs meet within like lengths only.
    sizes = lambda c: F.explode(F.sequence(F.ceil(F.length(c) * low), F.length(c))).alias("size")
    shorter = a.where("length(x) >= 2").select("x", pairs_of(F.col("x")), F.length("x").alias("lx"))
    longer = b.where("length(y) >= 2").select("y", pairs_of(F.col("y")), F.length("y").alias("ly"))
    fits = (F.col("x") != F.col("y")) & (F.col("lx") == F.col("size"))
    # Either side may be the shorter one; equal lengths come from the first join.
    one = shorter.join(longer.select("y", "g", sizes(F.col("y"))), "g").where(fits).select("x", "y")
    two = longer.join(shorter.select("x", "g", "lx", sizes(F.col("x"))), "g").where((F.col("ly") == F.col("size")) & (F.col("ly") < F.col("lx"))).select("x", "y")
    apart = one.unionAll(two).distinct().where(indel_ratio(F.col("x"), F.col("y")) >= config.surname_threshold)
    return a.join(b, F.col("x") == F.col("y")).select("x", "y").unionAll(apart)


def score_by_surname(reads: DataFrame, keys: DataFrame, config: MatchConfig, scorer: str) -> DataFrame:
    """The best candidates of each read among the books whose author's surname is near. Hot surnames are dealt into blocks."""
    reads, keys = reads.where("name is not null").withColumn("x", F.col("name.surname")), keys.where("row_name is not null").withColumn("y", F.col("row_name.surname"))
    counted = lambda df, c, n: df.groupBy(c).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias(n))
    a, b = counted(reads, "x", "read_blocks"), counted(keys, "y", "book_blocks")
    near = written(near_surnames(a.select("x"), b.select("y"), config).join(a, "x").join(b, "y"), "surnames")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = reads.join(near, "x").select("read_key", "norm_title", "name", "x", "y", own("read_key", "read_blocks").alias("rb"), every("book_blocks").alias("cb"))
    right = keys.join(near, "y").select("book_id", "book_title", "row_name", F.col("x").alias("x2"), F.col("y").alias("y2"), own("book_id", "book_blocks").alias("cb2"), every("read_blocks").alias("rb2"))
    parts, mine, theirs = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["x", "y", "rb", "cb"], ["x2", "y2", "rb2", "cb2"]
    return left.repartition(parts, *mine).groupBy(*mine).cogroup(right.repartition(parts, *theirs).groupBy(*theirs)).applyInArrow(tile(config, scorer), SCORED)


def score_blocked(reads: DataFrame, catalog: DataFrame | Prepared, config: MatchConfig = MATCH, scorer: str = "wratio") -> DataFrame:
    """Scores with those rows only that can decide an automatic match; decisions to match equal the exact mode's.

    An automatic match needs 0.90. A row whose author doesn't fit gets 0.75 at most, and one whose
    author is unknown 0.85; so the winner's surname is near the read's. Of other rows, 0.75 is too
    little to spoil a lead of 0.12, but 0.85 isn't: a read that would be matched among near surnames
    meets all rows without an author, in tiles, before it is. Reads without an author never match
    automatically and get no rows. Candidates, and hence margins, are of the rows that were met; a
    margin is an upper bound of the exact one.
    """
    if config.no_author_cap >= config.auto_score or config.auto_score - config.title_weight < config.auto_margin:
        raise ValueError("with these thresholds any row can decide a match: use the exact mode")
    prepared = catalog if isinstance(catalog, Prepared) else prepare(catalog, config)
    known = written(score_by_surname(reads, prepared.keys, config, scorer), "scores")
    doubtful = written(reads.join(leading(known, config), "read_key", "left_semi"), "reads")
    unknown = Prepared(prepared.catalog, prepared.keys.where("row_name is null"))
    return known.unionByName(score_exact(doubtful, unknown, config, scorer))


def leading(scored: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """(read_key): reads whose best book is good enough, and far enough ahead, for an automatic match."""
    lead = ranked(scored, 2).groupBy("read_key").agg(F.max("score").alias("first"), F.min(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    return lead.where((F.col("first") >= config.auto_score) & (F.col("first") - F.coalesce("second", F.lit(0.0)) >= config.auto_margin)).select("read_key")


def score_for_review(reads: DataFrame, catalog: DataFrame | Prepared, config: MatchConfig = MATCH, scorer: str = "wratio") -> DataFrame:
    """Blocked scores of the reads that match automatically; all others, which a person looks at, meet the whole catalog as in the exact mode."""
    prepared = catalog if isinstance(catalog, Prepared) else prepare(catalog, config)
    blocked = written(score_blocked(reads, prepared, config, scorer), "scores")
    sure = written(leading(blocked, config), "matched")
    rest = written(reads.join(sure, "read_key", "left_anti"), "reads")
    return blocked.join(sure, "read_key", "left_semi").select("read_key", "book_id", "title_score", "author_score", "score").unionByName(score_exact(rest, prepared, config, scorer))


#: How reads meet the catalog: all rows; what can decide an automatic match; the second, then the first for the rest.
MODES = {"exact": score_exact, "blocked": score_blocked, "review": score_for_review}


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """The n best books of each read with their rank ``r``, ties to the smaller book_id. A book that was met by several titles counts by the best."""
    by_read = scored.repartition("read_key").groupBy("read_key", "book_id").agg(F.max(F.struct("score", "title_score", "author_score")).alias("s")).select("read_key", "book_id", "s.*")
    return by_read.withColumn("r", F.row_number().over(W.partitionBy("read_key").orderBy(F.desc("score"), "book_id"))).where(F.col("r") <= n)


def top_candidates(scored: DataFrame, catalog: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """(read_key, candidates): the best, ties to the smaller book_id, with what is shown of a book."""
    shown = catalog.select("book_id", *[c if c in catalog.columns else F.lit("").alias(c) for c in SHOWN])
    item = F.struct("r", "book_id", F.col("title"), F.col("author"), "score", "title_score", "author_score", *SHOWN[2:])
    return ranked(scored, max(2, config.candidates)).join(shown, "book_id").groupBy("read_key").agg(F.sort_array(F.collect_list(item)).alias("candidates"))


def decide(df: DataFrame, config: MatchConfig = MATCH) -> DataFrame:
    """Adds confidence, margin and match_status to rows with ``title`` and ``candidates``."""
    blank = F.coalesce(strip(F.col("title")), F.lit("")) == ""
    cands = F.when(~blank, F.col("candidates"))
    best, second = F.get(cands, F.lit(0))["score"], F.coalesce(F.get(cands, F.lit(1))["score"], F.lit(0.0))
    df = df.withColumn("confidence", best).withColumn("lead", best - second)
    status = F.when(F.col("confidence").isNull() | (F.col("confidence") < config.review_score), "unmatched")
    status = status.when((F.col("confidence") >= config.auto_score) & (F.col("lead") >= config.auto_margin), "auto_added").otherwise("needs_review")
    df = df.withColumn("match_status", status).withColumn("margin", F.when(F.col("match_status") != "unmatched", F.col("lead"))).drop("lead")
    return df.withColumn("candidates", F.when(blank, F.slice("candidates", 1, 0)).otherwise(F.col("candidates")))


def color_tiebreak(candidates: Column, color: Column, margin: Column, config: MatchConfig = MATCH) -> Column:
    """Puts the one near-tied candidate with the read's colour first; nothing else changes."""
    lead = F.get(candidates, F.lit(0))["score"]
    tied = F.filter(candidates, lambda c: lead - c["score"] <= config.color_margin)
    same = F.filter(tied, lambda c: c["spine_color"] == color)
    applies = color.isNotNull() & (color != "") & (margin <= config.color_margin) & (F.size(tied) >= 2) & (F.size(same) == 1)
    moved = F.concat(same, F.filter(candidates, lambda c: c["book_id"] != F.get(same, F.lit(0))["book_id"]))
    return F.when(applies, moved).otherwise(candidates)


def candidates_payload(candidates: Column) -> Column:
    """What a detection stores of its candidates: scores rounded to four places."""
    return F.transform(candidates, lambda c: F.struct(c["book_id"].alias("book_id"), c["title"].alias("title"), c["author"].alias("author"), F.round(c["score"], 4).alias("score"), *[c[f].alias(f) for f in SHOWN[2:]]))


def match_reads(reads: DataFrame, catalog: DataFrame | Prepared, config: MatchConfig = MATCH, mode: str = "exact", scorer: str = "wratio") -> DataFrame:
    """Adds candidates, confidence, margin, match_status and chosen_book to reads (title, author, spine_color)."""
    if config.candidates < 2:
        raise ValueError("a margin needs at least two candidates")
    prepared = catalog if isinstance(catalog, Prepared) else prepare(catalog, config)
    forms = written(spelled(reads), "spelled")
    different = written(forms.select("read_key", "norm_title", "name").distinct(), "reads")
    scored = MODES[mode](different, prepared, config, scorer)
    best = forms.select(F.col("title").alias("t"), F.col("author").alias("a"), "read_key").join(top_candidates(scored, prepared.catalog, config), "read_key").drop("read_key")
    out = decide(reads.join(best, (F.col("title") == F.col("t")) & F.col("author").eqNullSafe(F.col("a")), "left").drop("t", "a"), config)
    out = out.withColumn("candidates", color_tiebreak(F.col("candidates"), F.col("spine_color"), F.col("margin"), config))
    return out.withColumn("chosen_book", F.when(F.col("match_status") == "auto_added", F.get("candidates", F.lit(0))["book_id"]))
