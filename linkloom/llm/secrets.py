"""Secret scans: candidates by shape, then a random forest that removes false positives.

A word is split at ``= : " ' &`` and the like, so that a name becomes the neighbour of its
value. Candidates are all runs of at least ``MIN_LENGTH`` key characters in each piece, long words
and numbers included; in a piece without any, a run of as many printable characters of all kinds
(dotted tokens, pass phrases with symbols); a value assigned to an announcing name, or a password
before ``@``, is one whole candidate from ``MIN_VALUE`` characters on. What the forest sees of a
candidate:

* its length, its shares of digits and capitals, how many different characters it has;
* character transitions: the mean log probability of its character pairs under a model counted
  over all words of the corpus (keys jump where language flows);
* dictionary coverage: the share of its characters that belong to words frequent in the corpus;
* the path it was found under, and the words before and after it, both as known cues and hashed.

The forest learns from labelled findings ``(doc_id, word_no, label)``, which label all candidates
of the word, or ``(doc_id, word_no, run_no, label)``. Where there are none, the corpus gives them:
a value that is assigned to an announcing name counts as a secret, one that is neither announced
nor assigned as none (``cued``). What tells these labels is then hidden from the forest, in teaching
and in scoring: the columns ``EVIDENCE``, and cues among the neighbouring words. So it has to
learn what the values themselves and the rest of their surroundings look like, and drops announced
values that look like the harmless ones.

All steps are DataFrame functions and Spark's own forest. The corpus model is two aggregations:
distinct words with their counts, and from these a table of at most 28 x 28 transitions, which is
broadcast.

Defined cases: null and empty texts have no candidates; null paths are an empty path; repeated
rows yield the same finding once; rows that share a doc_id yield each their own; a null doc_id is an
id like others, but can't be named by a finding; repeated labels of a finding count as secret if one
is; labels for other places teach nothing; without labels of both classes all scores are the
secrets' share among the labels (0.5 without any); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.shared import plain, table, words_of, written

MIN_LENGTH, MIN_VALUE = 16, 6
KEY = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}={{0,2}}"
#: Printable characters of all kinds, from a letter or digit to another.
WIDE = rf"[A-Za-z0-9][\x21-\x7E]{{{MIN_LENGTH - 2},}}[A-Za-z0-9]"
#: What separates pieces of a word, and a piece with its base64 padding, if any, and the separators behind it.
APART = r"=:\"'&,;(){}\[\]<>"
PIECE = rf"([^{APART}]+(?:={{1,2}}(?=$|[\"']?(?:$|[,;&)}}\]])))?)([{APART}]*)"
#: Occurrences from which a word of the corpus is in the dictionary.
DICTIONARY_COUNT = 5
#: Words that announce a secret, and words that announce something harmless.
ANNOUNCE = "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private"
HARMLESS = "example|sample|dummy|placeholder|test|sha|commit|md5|checksum|digest|uuid|version|revision|card|isbn"
TREES, DEPTH, HASHED = 20, 6, 16

#: A row of the table is told by its id and a hash of its text.
WORD_PLACE = ["doc_id", "row", "word_no"]
PLACE = [*WORD_PLACE, "run_no"]


def at_place(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Joins two tables by place; a null id equals a null id."""
    r = right.select(*[F.col(c).alias(f"r_{c}") if c in PLACE else F.col(c) for c in right.columns])
    same = F.col("doc_id").eqNullSafe(F.col("r_doc_id"))
    for c in PLACE[1:]:
        same = same & (F.col(c) == F.col(f"r_{c}"))
    return left.join(r, same, how).drop(*[f"r_{c}" for c in PLACE])


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, row (a hash of the text), word_no, run_no, candidate, word (its piece), path, and the two pieces before and the one after, lower-cased."""
    d = docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"), words_of(F.col("text")).alias("words"))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    # A value may stand in the word of its name, or up to two words behind it.
    near = lambda i: F.lower(F.concat(word(i - 2), word(i - 1), word(i)))
    value = lambda i: (F.length(word(i)) >= MIN_VALUE) & near(i).rlike("[=:]") & near(i).rlike(f"{ANNOUNCE}|:[^:]*@")
    fits = lambda i: ((F.length(word(i)) >= MIN_LENGTH) & word(i).rlike(f"{KEY}|{WIDE}")) | value(i)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), fits)
    found = F.transform(F.when(F.size("words") > 0, at), lambda i: F.struct(i.alias("word_no"), word(i).alias("whole"), F.lower(word(i - 1)).alias("b1"), F.lower(word(i - 2)).alias("b2"), F.lower(word(i + 1)).alias("a1")))
    d = d.select("doc_id", "row", "path", F.explode(found).alias("f")).select("doc_id", "row", "path", "f.*").dropDuplicates(WORD_PLACE)

    # The pieces of a word, each with the sign of an assignment that follows it.
    sign = lambda c: F.when(c.rlike("[=:]"), F.lit("=")).otherwise(F.lit(""))
    raw = F.regexp_extract_all("whole", F.lit(PIECE), F.lit(0))
    pieces = F.transform(raw, lambda x: F.struct(F.regexp_extract(x, PIECE, 1).alias("piece"), F.regexp_extract(x, PIECE, 2).alias("sep")))
    lead = sign(F.regexp_extract("whole", f"^[{APART}]*", 0))
    d = d.withColumn("lead", lead).withColumn("pieces", pieces).select("*", F.posexplode("pieces").alias("i", "p"))
    told = lambda x: F.lower(F.concat(x["piece"], sign(x["sep"])))
    own = lambda i: told(F.get("pieces", i))
    i = F.col("i")
    # In front of the first piece stand the word before, and a leading sign as a word of its own.
    outer = F.when(F.col("lead") == "=", F.array("lead", "b1")).otherwise(F.array("b1", "b2"))
    before = F.when(i >= 1, own(i - 1)).otherwise(outer[0])
    before2 = F.when(i >= 2, own(i - 2)).when(i == 1, outer[0]).otherwise(outer[1])
    d = d.withColumn("before", before).withColumn("before2", before2).withColumn("after", F.coalesce(own(i + 1), F.col("a1")))
    d = d.withColumn("word", F.col("p.piece"))
    named = F.col("before").rlike("[=:]$") & (F.col("before").rlike(ANNOUNCE) | (F.col("before").rlike("^[=:>]+$") & F.col("before2").rlike(ANNOUNCE)))
    plain_value = F.regexp_replace("word", r"[.!]+$", "")
    # A password stands between the colon behind an account's name and the last @.
    password = F.regexp_extract("word", "^(.*)@", 1)
    account = F.col("before").rlike("//.*=$") & (i >= 1) & (F.length(password) >= MIN_VALUE)
    keys, wide = (F.regexp_extract_all("word", F.lit(f"({p})"), F.lit(1)) for p in (KEY, WIDE))
    runs = F.when(F.size(keys) > 0, keys).otherwise(wide)
    d = d.withColumn("runs", F.when(account, F.array(password)).when(named & (F.length(plain_value) >= MIN_VALUE), F.array(plain_value)).otherwise(runs))
    d = d.select("doc_id", "row", "path", "word_no", "i", "word", "before", "before2", "after", F.posexplode("runs").alias("j", "candidate"))
    # A word has fewer than 2 ** 31 runs in all, but place within it is by piece and run.
    return d.withColumn("run_no", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("j"))).drop("i", "j")


def corpus_words(docs: DataFrame) -> DataFrame:
    """(w, n): all words of the corpus, their ASCII letters only, lower-cased. Counted raw first, so each is cleaned once."""
    raw = docs.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    clean = raw.select(F.lower(F.regexp_replace("raw", "[^A-Za-z]", "")).alias("w"), "n").where("w <> ''")
    return written(clean.groupBy("w").agg(F.sum("n").alias("n")), "words")


def letters(c: Column) -> Column:
    """Small letters stay, a digit is 0, all else is a hyphen; ^ and $ mark the ends."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), "[^a-z0]", "-"), F.lit("$"))


def pairs_of(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))


def transitions(words: DataFrame) -> DataFrame:
    """(pair, chance): the log probability of the second character after the first, smoothed."""
    pairs = words.select(letters(F.col("w")).alias("w"), "n").select(F.explode(pairs_of(F.col("w"))).alias("pair"), "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    first = counts.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("a")).select("pair", F.log((F.col("n") + 0.5) / (F.col("all") + 15)).alias("chance"))


#: What a pair that the corpus never has counts as.
UNSEEN = -9.0


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the forest's features to candidates."""
    c = F.col("candidate")
    spelled = found.select(*PLACE, letters(c).alias("w")).select(*PLACE, F.explode(pairs_of(F.col("w"))).alias("pair"))
    flow = spelled.join(F.broadcast(transitions(words)), "pair", "left").groupBy(*PLACE).agg(F.avg(F.coalesce("chance", F.lit(UNSEEN))).alias("flow"))
    known = words.where(F.col("n") >= DICTIONARY_COUNT).select("w")
    runs = found.select(*PLACE, F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    cover = runs.join(known, "w").groupBy(*PLACE).agg(F.sum(F.length("w")).alias("covered"))
    size = F.length(c).cast("double")
    share = lambda pattern: (size - F.length(F.regexp_replace(c, pattern, ""))) / size
    cue = lambda pattern, *cs: F.concat_ws(" ", *cs).rlike(pattern).cast("double")
    out = at_place(at_place(found, flow), cover)
    return out.select(
        *PLACE, "candidate", "before", "before2", "after", "path",
        F.least(size, F.lit(200.0)).alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64.0))).alias("different"), c.rlike("^[0-9a-f]+$").cast("double").alias("hex"),
        F.coalesce("flow", F.lit(UNSEEN)).alias("flow"), F.coalesce(F.col("covered") / size, F.lit(0.0)).alias("coverage"),
        cue(ANNOUNCE, "before", "before2", F.lower("word")).alias("announced"), cue(HARMLESS, "before", "before2", "after", "path").alias("harmless"),
        cue("[=:]$", "before").alias("assigned"), F.col("word").rlike("@|://").cast("double").alias("address"),
        F.size(F.split("path", "/")).cast("double").alias("depth"), cue("test|example|doc|fixture|vendor", F.lower("path")).alias("harmless_path"),
    )


#: What tells the labels of ``cued``.
EVIDENCE = ["announced", "harmless", "assigned"]
NUMBERS = ["length", "digits", "capitals", "different", "hex", "flow", "coverage", "announced", "harmless", "assigned", "address", "depth", "harmless_path"]


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", seed: int = 5, teach: str = "true") -> DataFrame:
    """One row per candidate: doc_id, word_no, run_no (its piece of the word, times 2 ** 32, and its place there), length, sha256, score, is_secret. The secret itself isn't copied.

    ``findings``: labelled findings (doc_id, word_no, label), with run_no if there is one. Without any, cues in the corpus
    label candidates, and the forest doesn't see these cues (``cued``). ``teach``: a condition on doc_id; only rows that fulfil it teach.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import FeatureHasher, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    docs = plain(docs, list(dict.fromkeys(["doc_id", "text", path])))
    found = written(described(written(candidates(docs, path), "candidates"), corpus_words(docs)), "described")
    if findings is None:
        # Candidates label themselves, row by row: no join.
        found = hidden(found)
        labelled = found.where("label in (0, 1)").where(teach)
    else:
        at = ["doc_id", "word_no", *(["run_no"] if "run_no" in findings.columns else [])]
        labels = plain(findings, [*at, "label"]).where("label in (0, 1)").where(teach).groupBy(*at).agg(F.max("label").cast("double").alias("label"))
        labelled = written(labels.join(found, at), "labelled")
    n, secret = labelled.agg(F.count(F.lit(1)), F.sum("label")).first()
    out = [*map(F.col, ["doc_id", "word_no", "run_no"]), F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("sha256")]
    if not n or secret in (0, n):
        score = F.lit(float(secret / n) if n else 0.5)
        return found.select(*out, score.alias("score"), (score >= 0.5).alias("is_secret"))
    hashed = FeatureHasher(inputCols=["before", "before2", "after", "path"], outputCol="around", numFeatures=HASHED)
    seen = NUMBERS if findings is not None else [c for c in NUMBERS if c not in EVIDENCE]
    joined = VectorAssembler(inputCols=[*seen, "around"], outputCol="features")
    prepare = lambda df: joined.transform(hashed.transform(df))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="onethird").fit(prepare(labelled.orderBy(*PLACE)))
    score = vector_to_array("probability")[1]
    scored = forest.transform(prepare(found)).withColumn("score", score)
    return scored.select(*out, "score", (F.col("score") >= 0.5).alias("is_secret"))


def cued() -> Column:
    """The label that a candidate's surroundings give it, null if they are ambiguous: 1 for a value assigned to an announcing name, 0 for one that is neither announced nor assigned."""
    announced, assigned, harmless = (F.col(c) == 1 for c in ("announced", "assigned", "harmless"))
    return F.when(announced & assigned & ~harmless, 1.0).when(~announced & ~assigned, 0.0)


def hidden(found: DataFrame) -> DataFrame:
    """Adds ``label`` as the cues have it, and takes the cues out of the neighbouring words.

    Candidates shorter than ``MIN_LENGTH`` exist behind announcing names only, so their length is a cue too: all up
    to twice that length have it, and their share of different characters is of as many.
    """
    cue = f"[=:]|{ANNOUNCE}|{HARMLESS}"
    blank = {c: F.when(F.col(c).rlike(cue), F.lit("")).otherwise(F.col(c)) for c in ("before", "before2", "after")}
    distinct = F.col("different") * F.least("length", F.lit(64.0))
    least = F.lit(2.0 * MIN_LENGTH)
    short = {"length": F.greatest("length", least), "different": distinct / F.greatest(F.least("length", F.lit(64.0)), least)}
    return found.withColumn("label", cued()).withColumns(blank | short)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
