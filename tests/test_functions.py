import math

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from stringmill.functions import formats, scores
from stringmill.functions.pieces import PATTERNS, lexical_check, pretokenize
from stringmill.functions.student import alternative_name, upper_tail
from stringmill.functions.text import (
    clean_generated,
    digest,
    enclose,
    identity_key,
    is_header,
    similar,
    strip_atom_mapping,
    template_key,
)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_cleaning_removes_every_mark(rows):
    df = rows("t string", ("^C C_O_",), ("^^",), ("C.C",))
    assert values(df, clean_generated(F.col("t"))) == ["CCO", "", "C.C"]
    assert values(df, enclose(F.col("t"), "<", ">"))[2] == "<C.C>"


def test_header_words(rows):
    df = rows("t string", ("smiles",), ("Molecule name",), ("CCO",), ("xSMILES",))
    assert values(df, is_header(F.col("t"))) == [True, True, False, False]


def test_template_key(rows):
    df = rows(
        "t string",
        ("[C:1].[O:2]>>[O:2][C:1]",),
        ("[O].[C]>>[O][C]",),
        ("C..O>>C",),
        ("C>>",),
        ("CC",),
        ("",),
    )
    assert values(df, template_key(F.col("t"))) == [
        "[C].[O]>>[O][C]",
        "[C].[O]>>[O][C]",
        None,
        None,
        "CC",
        None,
    ]
    upper = template_key(F.col("t"), lambda p: F.when(p != "CC", F.lower(p)))
    assert values(df, upper)[4] is None
    assert values(df, upper)[1] == "[c].[o]>>[o][c]"


def test_mapping_and_similarity(rows):
    df = rows("a string, b string", ("[C:1]:2", "[C:7]"), ("C.O>>N", "O.C>>N"), ("C>>", ".>>"))
    assert values(df, strip_atom_mapping(F.col("a")))[0] == "[C]"
    assert values(df, similar(F.col("a"), F.col("b"))) == [True, False, False]
    # two templates without a form count as similar
    assert values(df, similar(F.col("a"), F.col("b"), "canonical")) == [True, True, True]
    with pytest.raises(ValueError):
        similar(F.col("a"), F.col("b"), "other")


def test_identity_and_digest(rows):
    df = rows("r string, c string", ("x", None), ("x", "y"))
    assert values(df, identity_key(F.col("r"), F.col("c"))) == ["x", "y"]
    assert values(df, digest(F.col("c")).isNull()) == [True, False]


PROBES = [
    "D1H2R1X2x1h1C%12zz",
    "CC#N",
    "C##N",
    "c1ccccc1Cl",
    "[Na+].[Cl-]",
    "C[C@@H](N)C(=O)O",
    "[C:1]-[OH:2]>>[C:1]=[O:2]",
    "F/C=C\\F",
    "qqC--N",
    "C$(CC)",
    "prose with spaces, ümläut 😀 and [un closed",
    "]]][[",
]


@pytest.mark.parametrize("kind", ["CHAR", "ATOM", "SMARTS"])
def test_pieces_equal_the_library(rows, kind):
    if kind == "CHAR":
        want = [list(p) for p in PROBES]
    else:
        split = Split(Regex(PATTERNS[kind]), behavior="isolated")
        want = [[p for p, _ in split.pre_tokenize_str(s)] for s in PROBES]
    got = values(rows("t string", *[(p,) for p in PROBES]), pretokenize(F.col("t"), kind))
    assert got == want


def test_pieces_fixed_example(rows):
    df = rows("t string", (PROBES[0],), ("",))
    got = values(df, pretokenize(F.col("t"), "SMARTS"))
    assert got == ["D 1 H 2 R 1 X2 x1 h1 C %12 zz".split(), []]
    assert values(df, pretokenize(F.col("t"), pattern="[0-9]"))[0][:3] == ["D", "1", "H"]
    with pytest.raises(ValueError):
        pretokenize(F.col("t"), "WORDS")


def test_lexical_check(rows):
    cases = {
        "C(C)C1CC1": True,
        "C(C": False,
        "C)C(": False,
        "C1CC": False,
        "[C:1]%12CC%12": True,
        "C..C": False,
        "C>>": False,
        "[C": False,
        "qC": False,
        "[C:1].[O:2]>>[C:1][O:2]": True,
    }
    df = rows("t string", *[(k,) for k in cases])
    assert values(df, lexical_check(F.col("t"))) == list(cases.values())


def test_formats(rows):
    df = rows(
        "v double, p string",
        (3661.9, "a/b/run.tar.gz"),
        (86400.0, "/x/run/"),
        (200000.0, ".hidden"),
        (2.675, "name"),
        (None, "a.b"),
    )
    assert values(df, formats.format_duration(F.col("v"))) == [
        "1:01:01",
        "1 day, 0:00:00",
        "2 days, 7:33:20",
        "0:00:02",
        None,
    ]
    assert values(df, formats.path_stem(F.col("p"))) == ["run.tar", "run", ".hidden", "name", "a"]
    assert values(df, formats.format_metric(F.col("v"), ".2f")) == [
        f"{v:.2f}" for v in (3661.9, 86400.0, 200000.0, 2.675)
    ] + [None]
    assert values(df, formats.format_metric(F.col("v"), ".4f"))[1] == "86400.0000"
    half = rows("v double", (0.5,), (1.5,), (2.5,), (49.9999,))
    assert values(half, formats.round_epoch(F.col("v"))) == [0, 2, 2, 50]
    assert values(rows("n long", (3_145_728,)), formats.model_size_label(F.col("n"))) == ["3.00M"]


def test_scores(rows):
    df = rows("d double", (0.2192,), (1000.0,))
    score = values(df, scores.score_from_distance(F.col("d")))
    assert score[0] == pytest.approx(math.exp(-0.2 * 0.2192))
    back = values(df, scores.distance_from_score(scores.score_from_distance(F.col("d"))))
    assert back[0] == pytest.approx(0.2192)
    assert values(df, scores.perplexity(F.col("d")))[1] == math.inf


@pytest.mark.parametrize(
    "t,df,p",
    [
        (0.0, 5, 0.5),
        (2.015048372669157, 5, 0.05),
        (-2.015048372669157, 5, 0.95),
        (12.706204736432095, 1, 0.025),
        (1.6448536269514722, 1e9, 0.05),
        (2.3263478740408408, 1e9, 0.01),
    ],
)
def test_student_tail(t, df, p):
    assert upper_tail(t, df) == pytest.approx(p, rel=1e-6)


def test_alternative_names():
    assert alternative_name("two_sided") == alternative_name("two-sided") == "two-sided"
    with pytest.raises(ValueError):
        alternative_name("bigger")
