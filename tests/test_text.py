import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.config import COLORS
from linkloom.functions.text import clean_color, normalize_author, normalize_hex, normalize_spine_color, normalize_text, parse_flag, parse_year, split_pipe_list, strip, strip_accents


def column(spark, values, of, schema="c string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.select(of(F.col("c")), "i").orderBy("i").collect()]


def test_titles(spark):
    cases = {
        "The Hobbit": "hobbit", "Dune": "dune", "Foundation and Empire": "foundation and empire", "Harry Potter and the Philosopher's Stone": "harry potter and the philosophers stone",
        "  Snow   Crash  ": "snow crash", "": "", None: "", "Cien años de soledad": "cien anos de soledad", "The": "the", "İstanbul": "istanbul", "ﬁn ½": "fin 1 2", "a the b": "the b", "!!!": "", "中文 – 書": "中文 書",
    }
    assert column(spark, list(cases), normalize_text) == list(cases.values())


def test_authors(spark):
    same = ["Orwell, George", "George Orwell", "J.K. Rowling", "Rowling, J. K.", "Gabriel García Márquez", "Gabriel Garcia Marquez", None, "", "  ", "Cathy O'Neil", "Frederick P. Brooks Jr.", "Le Guin, Ursula K.", "Plato", ", George", "..."]
    got = [None if r is None else (r["surname"], r["initials"]) for r in column(spark, same, normalize_author)]
    jk, gm = ("rowling", ["j", "k"]), ("marquez", ["g", "g"])
    assert got == [("orwell", ["g"]), ("orwell", ["g"]), jk, jk, gm, gm, None, None, None, ("neil", ["c", "o"]), ("jr", ["f", "p", "b"]), ("le guin", ["u", "k"]), ("plato", []), None, None]


def test_lists_codes_years_flags(spark):
    assert column(spark, ["a| b ||", "", None], split_pipe_list) == [["a", "b"], [], []]
    hexes = {"#FCE153": "#FCE153", "fce153": "#FCE153", "  #c59ec9  ": "#C59EC9", "": "", "purple": "", "#FFF": "", "#GGGGGG": "", "#FCE1533": "", None: ""}
    assert column(spark, list(hexes), normalize_hex) == list(hexes.values())
    assert column(spark, ["1995", " ", None], parse_year) == [1995, None, None]
    assert column(spark, ["x"], lambda c: parse_year(c, "null")) == [None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["x"], parse_year)
    assert column(spark, [" TRUE ", "false", "", None], parse_flag) == [True, False, False, False]


def test_colors(spark):
    cases = {"yellow": "yellow", "Yellow": "yellow", "  PURPLE  ": "purple", "grey": "gray", "navy": "blue", "burgundy": "red", "lilac": "purple", "multicolored": "multicolour", "multi-colour": "multicolour", "dark navy blue": "blue", "pale yellow": "yellow", "": None, None: None, "chartreuse": None, "wooden": None, "sandy dune tone": None}
    assert column(spark, list(cases), normalize_spine_color) == list(cases.values())
    assert column(spark, list(COLORS), normalize_spine_color) == list(COLORS)


def test_white_space_of_all_kinds(spark):
    """Tabs, line ends, no-break spaces and the separators of ASCII count like blanks."""
    ends = ["\t", "\n", "\r\n", "\u00a0", "\u2003", "\x1c", "\x1f", "\x0b", "\u3000 \t"]
    assert column(spark, [f"{e}a{e}b{e}" for e in ends] + ["", None, "\n \u00a0"], strip) == [f"a{e}b" for e in ends] + ["", None, ""]
    assert column(spark, [f"#fce153{e}" for e in ends], normalize_hex) == ["#FCE153"] * len(ends)
    assert column(spark, [f"{e}true{e}" for e in ends], parse_flag) == [True] * len(ends)
    assert column(spark, [f"{e}1995{e}" for e in ends] + ends, parse_year) == [1995] * len(ends) + [None] * len(ends)
    assert column(spark, [f"a{e}|{e}|{e}b" for e in ends], split_pipe_list) == [["a", "b"]] * len(ends)
    assert column(spark, [f"{e}Multi-colour{e}" for e in ends] + [f"Red{e}" for e in ends], normalize_spine_color) == ["multicolour"] * len(ends) + ["red"] * len(ends)
    assert column(spark, [f"Red{e}" for e in ends], clean_color) == ["red"] * len(ends)
    assert column(spark, [f"{e}The{e}{e}Hobbit{e}" for e in ends], normalize_text) == ["hobbit"] * len(ends)


def test_a_batch_of_long_texts_stays_out_of_python():
    """Of a full Arrow batch, few texts are strings of Python at a time."""
    texts = pa.array(["été " * 1000 if i % 2 else None for i in range(10_000)])
    tracemalloc.start()
    try:
        got = strip_accents.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[1].as_py() == "ete " * 1000 and got[0].as_py() is None and len(got) == 10_000 and strip_accents.func(texts[:0]).to_pylist() == []
    assert peak < 8_000_000  # as strings, all of them and their results take 60 MB
