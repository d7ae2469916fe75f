"""Edge rows of the text rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkrank.functions import keys as ky
from linkrank.functions import nested as ns
from linkrank.functions import text as tx


def apply(spark, rule, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["out"] for r in df.select("i", rule(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, rule, cases, kind="string"):
    assert apply(spark, rule, [c[0] for c in cases], kind) == [c[1] for c in cases]


def test_primary_entity(spark):
    check(
        spark,
        ky.primary_entity,
        [
            ("2Pac Duet With Mopreme", "2Pac"),
            ("Patti Austin A Duet With James Ingram", "Patti Austin"),
            ("Elvis Presley With The Jordanaires", "Elvis Presley"),
            ("Elvis Presley vs JXL", "Elvis Presley vs JXL"),
            ("Kool & The Gang", "Kool & The Gang"),
            ("Earth, Wind & Fire", "Earth, Wind & Fire"),
            ("Bill Withers", "Bill Withers"),
            ("a FEATURING b", "a FEATURING b"),
            ("A With B Featuring C", "A With B"),
            ("A Featuring B Featuring C", "A"),
            (None, None),
        ],
    )


def test_older_ladders_show_why_the_order_matters(spark):
    credit = ["Patti Austin A Duet With James Ingram"]
    assert apply(spark, lambda c: ky.primary_entity(c, (" Featuring ", " With ")), credit) == [
        "Patti Austin A Duet"
    ]
    assert apply(spark, lambda c: ky.primary_entity(c, (" Duet With ", " With ")), credit) == [
        "Patti Austin A"
    ]


def test_title_cut_tail(spark):
    check(
        spark,
        ky.title_cut_tail,
        [
            ("X (feat. Y)", "X"),
            ("X (With Y)", "X"),
            ("X (FEAT. Y)", "X"),
            ("Single Ladies (Put a Ring on It)", "Single Ladies (Put a Ring on It)"),
            ("X (with A) (feat. B)", "X (with A)"),
            ("(feat. B)", "(feat. B)"),
            ("İX (feat. B)", "İX"),
            (None, None),
        ],
    )


def test_title_cut_dash(spark):
    check(
        spark,
        ky.title_cut_dash,
        [("Dreams - 2004 Remaster", "Dreams"), ("Heart-Shaped Box", "Heart-Shaped Box"), ("a - b - c", "a")],
    )


def test_fold_title(spark):
    check(
        spark,
        ky.fold_title,
        [
            ("Paint It, Black", "paint it black"),
            ("Hey, Soul Sister", "hey soul sister"),
            ("The Boys of Summer", "boys of summer"),
            ("Don’t Speak", "dont speak"),
            ("don't speak", "dont speak"),
            ("A the an a b", "b"),
            ("The", ""),
            ("?", ""),
            ("x    y", "x  y"),
            ("a a b", "a b"),
            ("Heart-Shaped [Box] & Co", "heart-shaped [box] & co"),
        ],
    )


def test_key_levels_each_change_something(spark):
    titles = ["Song (feat. Z)", "Song - Live", "Song!"]
    keys = [apply(spark, lambda c, n=n: ky.match_key(c, n), titles) for n in range(4)]
    assert keys[0] == ["song (feat. z)", "song - live", "song!"]
    assert keys[1] == ["song", "song - live", "song!"]
    assert keys[2] == ["song", "song", "song!"]
    assert keys[3] == ["song", "song", "song"]
    assert apply(spark, lambda c: ky.song_key(c, 2), ["Song - Live"]) == ["song - live"]


def nested_replace(text):
    """The same rule as a chain of single replacements, on plain strings."""
    out = text.lower()
    for c in "'’‘\"“”":
        out = out.replace(c, "")
    for c in ",.!?()*:;/":
        out = out.replace(c, " ")
    out = f" {out} "
    for c in (" a ", " an ", " the ", "  "):
        out = out.replace(c, " ")
    return out.strip(" ")


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.text(st.sampled_from("aAnthe THE'’‘\"“”,.!?()*:;/-&éÉx"), max_size=30), min_size=1, max_size=200
    )
)
def test_fold_title_equals_replace_chain(spark, texts):
    assert apply(spark, ky.fold_title, texts) == [nested_replace(t) for t in texts]


def test_lower_unicode_and_ascii(spark):
    assert apply(spark, ky.artist_key, ["BEYONCÉ"]) == ["beyoncé"]
    assert apply(spark, lambda c: ky.artist_key(c, ascii_only=True), ["BEYONCÉ"]) == ["beyoncÉ"]


def test_contains_ci_takes_wildcards_literally(spark):
    assert apply(spark, lambda c: tx.contains_ci(c, "50% O_f"), ["now 50% o_f!", "now 50 of"]) == [True, False]


def test_markers(spark):
    check(
        spark,
        tx.has_any_marker,
        [("Song REMIX", True), ("Lively", False), ("So lively", True), ("Song", False), (None, None)],
    )


def test_duration(spark):
    check(
        spark,
        tx.duration_text,
        [(61_000, "1:01"), (0, ""), (None, ""), (600_999, "10:00"), (59_999, "0:59")],
        "bigint",
    )


def test_tier_edges(spark):
    check(
        spark,
        tx.tier,
        [
            (199_999, "hidden gem"),
            (200_000, "middle band"),
            (999_999, "middle band"),
            (1_000_000, "buried anthem"),
        ],
        "bigint",
    )


def test_year4(spark):
    check(spark, tx.year4, [("1999", 1999), ("1999-05", 1999), ("", None), ("unknown", None), ("199", 199), ("19-9", None)])


def test_decades(spark):
    assert apply(spark, tx.decade_of_date, ["1987-05-02"]) == ["1980s"]
    assert apply(spark, tx.decade_ladder, ["2021-01-01", "1999-12-31", "1949-01-01"]) == ["2020s", "1990s", "earlier"]


def test_strip_quotes_and_first_tag(spark):
    assert apply(spark, tx.strip_quotes, ['say "hi"']) == ["say  hi "]
    check(spark, ns.first_tag, [("rock|pop", "rock"), ("rock", "rock"), ("", ""), (None, "")])
    check(spark, lambda c: ns.has_tag(c, "pop"), [("rock|pop", True), ("popular", False)])


@pytest.mark.parametrize("top,bottom,expected", [(596, 100, 6.0), (5, 0, None)])
def test_ratio_rounds_and_guards(spark, top, bottom, expected):
    df = spark.createDataFrame([(top, bottom)], "a bigint, b bigint")
    assert df.select(F.round(tx.ratio(F.col("a"), F.col("b")), 1).alias("r")).first()["r"] == expected


def test_cut_before_ignores_ascii_case_only(spark):
    check(
        spark,
        lambda c: tx.cut_before(c, " Ké ", ignore_case=True),
        [("a kÉ b", "a kÉ b"), ("a KÉ b", "a KÉ b"), ("a ké b", "a"), ("a Ké b ké c", "a"), ("Ké", "Ké")],
    )
