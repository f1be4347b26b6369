import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(rnd, n, per_line=12):
    words = [rnd.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) + "." for i in range(0, n, per_line))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (id, text) pairs; columns with clashing names come along."""

    def build(*texts, extra=False):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts, 1)]
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(rows, DOC)
        if extra:
            for c in ("row", "h", "k", "words", "key", "id", "block", "size", "score", "bucket", "place", "cut_doc", "left", "target"):
                df = df.withColumn(c, df["doc_id"] * 0)
        return df

    return build


@pytest.fixture
def rnd():
    return random.Random(5)


#: Texts that every operator must take: nulls, blanks, ties, repeats, a long one.
ODD = [None, "", "  \n\t ", "one", "a b", "x " * 30_000, "same text here again and again", "same text here again and again"]
