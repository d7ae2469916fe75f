"""Odd rows, general interfaces and hard cases of the operators without a test file of their own."""

import contextlib
import hashlib
import html
import io
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD
from pyspark.sql import functions as F
from test_registered import check_packing

from linkrank.llm import arrow, chat, codes, leaks, packing, pages, private, quality, sketch
from linkrank.llm.tokens import Encoder, default_vocabulary, encoder


# Token ids and files


def _ids(one, texts):
    raw, at = arrow.raw_bytes(pa.array(texts, pa.string()))
    ids, bounds = one.encode(raw[at[0] : at[-1]], at - at[0])
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([" ", " ", "\n", "\t", "　", "\x1c", "a", "Bc", "1", ".", "'s", "é", "<|endoftext|>"]), max_size=14))
def test_words_looked_up_give_the_same_ids(parts):
    one, text = encoder(default_vocabulary()), "".join(parts)
    assert _ids(one, [text]) == [one.tokenizer.encode(text, add_special_tokens=False).ids]


def test_ids_do_not_depend_on_what_is_kept():
    one = Encoder(default_vocabulary(), kept_pieces=3)
    texts = ["a b c d", "", "a  b\n\n c", "e f g h i " * 50, " \n ", "end \n"] * 3
    assert _ids(one, texts) == [one.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


# Hashes of words


def test_regular_words_do_not_collide():
    """Words made of a Thue-Morse sequence and its complement meet in any polynomial modulo 2 ** 64."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    words = [one, one.translate(str.maketrans("ab", "ba")), "x" * 64, "x" * 65, "x" * 8, "x" * 9, "x\0", "x"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    found, first = arrow.word_hashes(data, np.array([0, len(data)]))
    assert len(set(found.tolist())) == len(words) == first[1]
    again, _ = arrow.word_hashes(np.frombuffer(("y " + words[0]).encode(), np.uint8), np.array([0, 2 + len(words[0])]))
    assert again[1] == found[0]


def test_sketch_never_takes_a_repeated_hash_for_a_single_one(spark, docs):
    values = np.concatenate([np.arange(40000), np.arange(0, 40000, 7), np.full(500, 3)]).astype(np.uint64)
    rows = spark.range(4).repartition(4)

    def hashes(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield arrow.mix(values[i::4])

    found = sketch.repeated(rows, hashes, sketch.cells_for(len(values))).value
    told = found.may_have(arrow.mix(np.arange(40000, dtype=np.uint64)))
    assert told[::7].all() and told.mean() < 0.5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_any_id_can_be_read_alone(ids):
    block = codes.Codes(codes.pack(np.array(ids, np.uint32)))
    assert block.all().tolist() == ids and len(block) == len(ids)
    assert all(block[i] == ids[i] for i in range(0, len(ids), 37))
    assert all(block.read(i, i + 90).tolist() == ids[i : i + 90] for i in range(0, len(ids) - 90, 61))
    assert block.read(len(ids), len(ids)).tolist() == []
    with pytest.raises(IndexError):
        block[len(ids)]


def test_token_files_of_odd_rows(spark, docs, folder):
    found = codes.write_tokens(docs(ODD), f"{folder}/tokens", block_ids=50)
    assert found.count() > 3
    rows = sorted(map(tuple, codes.read_tokens(spark, f"{folder}/tokens").collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 10]
    assert [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist()
    assert {r[2] for r in rows if r[0] in (1, 2)} == {1}
    codes.write_tokens(docs([]), f"{folder}/none")
    assert codes.read_tokens(spark, f"{folder}/none").collect() == []


# Packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_best_filling_is_best(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums |= {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    taken = packing.best_filling(counts, room)
    assert all(0 < n <= counts[k] for k, n in taken.items())
    assert sum(k * n for k, n in taken.items()) == max(sums)


def test_packing_odd_rows(docs):
    unique = [(i if i is not None else -(k + 1), t) for k, (i, t) in enumerate(ODD)]
    unique = list({i: (i, t) for i, t in unique}.values())
    one = encoder(default_vocabulary()).tokenizer
    for capacity in (16, 1024):
        rows = [tuple(r) for r in packing.pack(docs(unique), capacity=capacity).collect()]
        check_packing(rows, dict(unique), one, capacity)
    assert len(packing.pack(docs(ODD)).where("doc_id = 5").collect()) == 2
    assert packing.pack(docs([])).collect() == []


def test_a_third_of_all_rests_of_one_length(docs):
    rows = [(k, "one two three") for k in range(400)] + [(1000 + k, "word " * (k % 37 + 1)) for k in range(800)]
    got = packing.pack(docs(rows), capacity=64).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes <= 64).all() and got.length.sum() / (64 * len(sizes)) > 0.98


# Quality


def test_quality_of_odd_rows(docs):
    rows = {r["doc_id"]: r for r in quality.score(docs(ODD)).collect()}
    assert (rows[1]["n_words"], rows[1]["base_failed"], rows[1]["kept"]) == (0, True, False)
    assert rows[5]["n_repeat_words"] == 48
    assert (rows[7]["n_words"], rows[7]["word_chars"]) == (36, 9 * 15)
    assert quality.score(docs([])).collect() == []
    frame = docs(ODD)
    kept = quality.filter_documents(frame)
    assert kept.dtypes == frame.dtypes


def test_bad_hosts_are_rejected_and_small_ones_are_not(docs):
    good = " ".join(f"g{k}" for k in range(80))
    rows = [(k, "short", "bad.example") for k in range(400)] + [(1000, good, "bad.example"), (1001, good, None)]
    rows += [(2000 + k, good, f"host{k % 9}") for k in range(300)]
    rows += [(5000, "short", "tiny.example")]
    found = {r["doc_id"]: r["kept"] for r in quality.score(docs(rows)).collect()}
    assert not found[1000] and found[1001] and found[2000] and not found[5000]


def test_hosts_stand_out_by_any_rule(docs):
    good = " ".join(f"g{k}" for k in range(80))
    rows = [(k, good, f"host{k % 12}") for k in range(600)]
    rows += [(1000 + k, good + " # $ %" * (k % 4 > 0) * 5, "symbols.example") for k in range(60)]
    rows += [(2000 + k, good + "\nthe same line" * 9, "lines.example") for k in range(60)]
    rows += [(3000 + k, good + " # $ %" * 5, "few.example") for k in range(1)]
    rows += [(4000 + k, " ".join(f"#{j}" for j in range(99)) + " " + good, f"host{k}") for k in range(12)]
    found = {r["doc_id"]: r["kept"] for r in quality.score(docs(rows)).collect()}
    assert not any(v for k, v in found.items() if 1000 <= k < 3000)
    assert all(v for k, v in found.items() if k < 1000 or k >= 3000)


def test_hosts_that_differ_by_chance_only_have_no_cut(docs):
    rng = np.random.default_rng(1)
    good = " ".join(f"g{k}" for k in range(80))
    rows = [(k, "short" if rng.random() < 0.6 else good, f"host{k % 15}") for k in range(900)]
    found = quality.score(docs(rows))
    assert found.where("kept = base_failed").count() == 0


def test_lines_and_symbols():
    text = "a b\na b\n\n\n x#$ \n x#$ \nlast <|>"
    assert quality.measure_text(text.encode())[2:4] == (4 + 3, 2)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PRIVATE = [
    "mail a.b+c@x-y.co.uk, then b@c.d@e.f and _@q.r._x@s.t or @@ a@b",
    "1.2.3.4.5.6.7.8 999.1.1.1 0.0.0.256 00255.0.0.01 é10.0.0.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5500005555555559",
    "+49 (30) 1234-5678. +1.2 +123456789012345678 ++33 1 23 45 67 89--",
    "\U0001f600 née a@b.cd \U0001f600 " * 400,
    "12 " * 3000,
]


def test_base_spans_equal_plain_patterns(docs):
    rows = ODD + [(100 + k, t) for k, t in enumerate(PRIVATE)]
    got = private.report(docs(rows))
    expected = []
    for i, t in rows:
        spans = base_spans(t or "")
        counts = [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        expected.append((i, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(expected, key=str)
    assert private.report(docs([])).collect() == []


def test_checksums_and_nearby_words_decide(docs):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [
        (1, "Konto DE89 3704 0044 0532 0130 00 und GB82WEST12345698765432"),
        (2, "Konto DE89 3704 0044 0532 0130 01"),
        (3, "ssn 123-45-6789"),
        (4, "part 123-45-6789, ssn 666-45-6789 far away"),
        (5, f'token = "{token}"'),
        (6, f"commit {token}"),
        (7, "ES91 2100 0418 4502 0005 1332 BIC CAIXESBB, BE68 5390 0754 7034 EUR 500, AT611904300234573201 123"),
        (8, "123-45-6789 is his social security number"),
        (9, "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bD1fG is the api key"),
        (10, "NO93 8601 1117 947"),
    ]
    got = {r["doc_id"]: r["spans"] for r in private.report(docs(rows)).collect()}
    assert got[1] == "iban:6:33,iban:38:60" and got[2] == ""
    assert got[3].endswith("ssn:4:15") and "ssn" not in got[4]
    assert got[5] == "secret:9:49" and got[6] == ""
    assert got[7] == "iban:0:29,iban:44:63,iban:73:93" and got[8] == "ssn:0:11"
    assert got[9] == "secret:0:32" and got[10] == "iban:0:18"


def test_redaction(docs):
    frame = docs([(1, "a@b.cd é +49 30 12345678!"), (2, "clean"), (3, None), (4, "x@1.2.3.4 y " * 300)])
    out = private.redact(frame)
    assert out.dtypes == frame.dtypes
    rows = {r["doc_id"]: r for r in out.collect()}
    assert (rows[1]["text"], rows[1]["n_chars"]) == ("[EMAIL] é [PHONE]!", 18)
    assert (rows[2]["text"], rows[3]["text"], rows[3]["n_chars"]) == ("clean", None, None)
    assert rows[4]["text"] == "[EMAIL] y " * 300


# Benchmark leaks


def test_reparameterised_questions(docs, spark):
    item = "A train leaves at 9 and goes 120 km to reach Boston before the 9 oclock bell rings for Alice"
    other = "One fish two fish red fish blue fish swims over the wide and silent sea tonight"
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short"), (2, other)], "item_id bigint, text string")
    rows = [
        (1, "so " + item.replace("9", "7").replace("120", "80").replace("Boston", "Lyon") + " end"),
        (2, item.replace("at 9", "at 7").replace("120 km", "44 miles")),  # 9 stands for 7 and for 9
        (3, "filler " + other.upper() + " filler"),
        (4, "One fish two fish swims elsewhere " + "nothing to see " * 9),
    ]
    found = {r["doc_id"]: r for r in leaks.report(docs(rows + [(i and i + 100, t) for i, t in ODD]), bench).collect()}
    assert found[1]["item_ids"] == [1] and found[1]["reparameterised"]
    assert not found[2]["contaminated"] and not found[4]["contaminated"]
    assert not any(r["contaminated"] for i, r in found.items() if i is None or i > 100)
    none = bench.where("item_id > 9")
    assert not any(r["contaminated"] for r in leaks.report(docs(rows), none).collect())
    assert leaks.report(docs([]), bench).collect() == []
    frame = docs(rows + ODD)
    kept = leaks.drop_leaks(frame, bench)
    assert kept.dtypes == frame.dtypes and kept.where("doc_id = 1").count() == 1
    big = leaks.find_leaks(docs(rows), bench)
    assert {(r["doc"], r["item"]) for r in big.collect()} >= {(1, 1)}


def test_a_large_benchmark_is_joined_by_shuffling(docs, spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", 0)
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = leaks.report(docs([(1, "x " + item), (2, "y")]), bench).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == {1: True, 2: False}


def leaked(docs, spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r["doc_id"]: r for r in leaks.report(docs(list(enumerate(texts))), bench).collect()}
    return [got[i] for i in range(len(texts))]


def test_one_inconsistent_value_does_not_hide_a_leak(docs, spark):
    item = "A train leaves at 9 and goes 120 km to reach Boston before the 9 oclock bell rings for Alice"
    two = "When Bob adds 2 apples to 2 pears and then gives away 8 of them to his sister how many are left over"
    texts = [item.replace("at 9", "at 7"), two.replace("2 apples", "3 apples").replace("2 pears", "4 pears").replace("8", "5"), two]
    edited, roles, same = leaked(docs, spark, texts, [item, two])
    assert (edited["item_ids"], edited["coverage"]) == ([0], 11 / 16)
    assert roles["item_ids"] == [1] and roles["reparameterised"] and 0.5 <= roles["coverage"] < 1
    assert (same["item_ids"], same["coverage"], same["reparameterised"]) == ([1], 1.0, False)


def test_copies_in_one_case(docs, spark):
    item = "Gestern lief der Hund mit dem Ball durch den Garten und für 5 Euro schlief die Katze im Haus"
    texts = [item.lower(), item.upper(), item, item.lower().replace("5 euro", "7 euro")]
    got = leaked(docs, spark, texts, [item])
    assert [(r["item_ids"], r["coverage"], r["reparameterised"]) for r in got] == [([0], 1.0, x) for x in (False, False, False, True)]


def test_long_runs_and_short_items(docs, spark):
    word = [f"{a}{b}" for a in ("be", "ca", "do", "fi", "gu", "ha", "jo") for b in ("la", "mi", "no", "pe", "ru", "sa", "ti")]
    long = " ".join(word)
    items = [long, "Paris in spring", "9 times", "今日は良い天気ですね", "東京"]
    texts = [
        f"so {' '.join(word[4:17])} end",  # 13 words
        f"so {' '.join(word[4:16])} end",
        "he saw PARIS, in spring, and went",
        "he saw Paris spring 8 times",
        "彼は今日は良い天気ですねと言った",
        "so 9 times 東京都",
    ]
    got = leaked(docs, spark, texts, items)
    assert [r["item_ids"] for r in got] == [[0], [], [], [], [3], []]
    assert [r["short_item_ids"] for r in got] == [[], [], [1], [], [], [2, 4]]
    assert [r["coverage"] for r in got] == [9 / 45, 0, 0, 0, 1, 0]
    assert [r["contaminated"] for r in got] == [True, False, False, False, True, False]
    assert not any(r["reparameterised"] for r in got)


def test_short_answers_drop_nothing_and_numbers_meet_equal_ones_only(docs, spark):
    items = ["yes", "42", "1 2 3 4 5 6 7 8", "Sum of 3 4 5 6 7 8 9 and the rest is given"]
    texts = ["yes, 42 is it", "9 9 9 1 2 3 4 5 6 7 8 9 9", " ".join(map(str, range(100, 160))), "sum of 5 6 7 8 9 1 2 and the rest is given"]
    got = leaked(docs, spark, texts, items)
    assert [r["item_ids"] for r in got] == [[], [2], [], [3]] and got[0]["short_item_ids"] == [0, 1]
    assert got[1]["coverage"] == 1 and not got[1]["reparameterised"] and got[3]["reparameterised"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    kept = leaks.drop_leaks(docs(list(enumerate(texts))), bench).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2]


_PLAIN_TOKEN = re.compile(r"[A-Za-z]+(?:['/-][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*")


def plain_windows(text, size=5):
    """(position, template, slots) of every window of an ASCII text, with and without names."""
    tokens = []
    for m in _PLAIN_TOKEN.finditer(text):
        before = text[max(0, m.start() - 2) : m.start()]
        name = m[0][0].isupper() and len(before) == 2 and before[1].isspace() and before[0] not in ".!?:" and not before[0].isspace()
        tokens.append((m[0].lower(), name))
    out = []
    for typed in (True, False):
        kinds = []
        for i, (word, name) in enumerate(tokens):
            after_number = i and tokens[i - 1][0][0].isdigit()
            kind = "3" if name and typed else "1" if word[0].isdigit() else "2" if after_number and word in leaks.UNITS else ""
            kinds.append((kind, ("\2" if kind == "3" else "") + word))
        for p in range(len(tokens) - size + 1):
            part = kinds[p : p + size]
            if not typed and not any(name for _, name in tokens[p : p + size]):
                continue
            slots = tuple(k + w for k, w in part if k)
            template = tuple(k or w for k, w in part)
            bare = all(k for k, _ in part)
            out.append((p, (template, slots if bare else None), slots, not bare))
    return out


def plain_leaks(text, item, coverage=0.5, run=13, size=5):
    """All windows against all windows: (leaked, coverage, reparameterised)."""
    known = plain_windows(item)
    found = {(p - q, q, s, t) for p, a, s, _ in plain_windows(text) for q, b, t, _ in known if a == b}
    worded = {q for q, _, _, w in known if w} or {q for q, *_ in known}
    values = {}
    for d, _, s, t in found:
        for new, old in zip(s, t):
            values.setdefault((d, old), set()).add(new)
    chance = {}
    for (d, old), news in values.items():
        if len(news) > 1:
            chance.setdefault(d, []).append((old, old in news))
    covered = {}
    for d, q, s, t in found:
        olds = chance.get(d)
        if s == t or not olds or not any(k for _, k in olds) and not {o for o, _ in olds} & set(t):
            covered[q] = covered.get(q, False) or s != t
    covered = {q: c for q, c in covered.items() if q in worded}
    share = len(covered) / len(worded) if worded else 0
    exact = {(d, q) for d, q, s, t in found if s == t}
    in_a_row = any(all((d, q + k) in exact for k in range(run - size + 1)) for d, q in exact)
    hit = bool(known) and (share >= coverage or in_a_row)
    return hit, share if hit else 0, hit and any(covered.values())


def test_leaks_equal_all_windows_against_all(docs, spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("re", "sa", "ti", "vo")] + ["km", "kg", "the"]
    names = ["Alice", "Bob", "Carol"]

    def sentence(n):
        kinds = rng.choice(3, n, p=[0.7, 0.18, 0.12])
        return [str(rng.choice([words, [str(k) for k in range(12)], names][k])) for k in kinds]

    items = [sentence(int(rng.integers(5, 30))) for _ in range(12)]
    texts = []
    for k in range(90):
        one = list(items[k % len(items)])
        low = int(rng.integers(0, len(one)))
        part = one[low // 2 : max(low, len(one) - low // 3)]
        change = rng.random(3) < 0.5
        swap = {w: str(rng.integers(0, 12)) for w in set(part) if w.isdigit() and change[0]}
        swap |= {w: str(rng.choice(names)) for w in names if change[1]}
        part = [swap.get(w, w) for w in part]
        if change[2] and part:
            part[int(rng.integers(0, len(part)))] = str(rng.choice(words))
        texts.append(" ".join(sentence(int(rng.integers(0, 9))) + part + sentence(int(rng.integers(0, 9)))))
    items = [" ".join(x) for x in items]
    got = leaked(docs, spark, texts, items)
    n = 0
    for text, r in zip(texts, got, strict=True):
        plain = [plain_leaks(text, x) for x in items]
        expected = [i for i, x in enumerate(plain) if x[0]]
        n += len(expected)
        assert (r["item_ids"], r["contaminated"]) == (expected, bool(expected)), text
        assert r["coverage"] == pytest.approx(max(x[1] for x in plain)) and r["reparameterised"] == any(x[2] for x in plain), text
    assert 30 < n


def test_window_search_is_compiled(docs, spark):
    """No lambda is interpreted per word, and what is compiled stays under the 8,000 bytes up to which the JVM makes it fast."""
    text = docs([(1, "a Bob c 5 km e")])
    short = leaks._find_short(text.selectExpr("doc_id doc", "0L tie", "text doc_text"), spark.sql("SELECT 1L item, 2L version, 'Bob' item_text"), 5)
    found = leaks.windows(text, ["doc_id", "tie", "n_chars"], F.col("text"))
    known = found.selectExpr("template", "position AS item_position", "slots AS item_slots")
    joined = found.join(F.broadcast(known), "template")
    joined = joined.select("doc_id", "tie", "n_chars", (F.col("position") - F.col("item_position")).alias("diagonal"), "slots", "item_slots").distinct()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for plan in (joined, short):
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                plan.select("*").explain("codegen")  # planned anew without adaptive execution
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
            assert sizes and max(sizes) < 8000
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                plan.select("*").explain()
            assert "lambda" not in out.getvalue()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


# Chat


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>", "", "\ue000r"]), st.lists(
    st.sampled_from([*chat.CONTROLS, chat.GUARD, "\ue000", "\ue001", "<", "[", "|>", "/s>", "x", "\n"]), max_size=7).map("".join)), max_size=5))
def test_escapes_can_be_undone(messages):
    whole, spans, rewrites = chat.locate(chat.marked_turns, messages)
    assert whole == chat.marked_turns(messages) or not messages
    assert not rewrites
    if messages:
        assert chat.parse(whole) == messages
    for (_, text), (start, end, low, high) in zip(messages, spans, strict=True):
        assert start <= low <= high <= end and chat.unescape(whole[low:high]) == text


def test_templates_that_rewrite_history_are_told():
    def forgets(messages):
        return "".join(f"<{r}>{t}" if k == len(messages) - 1 or r != "assistant" else f"<{r}>" for k, (r, t) in enumerate(messages))

    talk = [("user", "hi"), ("assistant", "thought"), ("user", "more"), ("assistant", "done")]
    whole, spans, rewrites = chat.locate(forgets, talk)
    assert rewrites and whole == "<user>hi<assistant><user>more<assistant>done"
    assert [whole[a:b] if a >= 0 else None for _, _, a, b in spans] == ["hi", None, "more", "done"]


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (None, 0, None, "x"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(turns.withColumn("conv", F.lit("clash")))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\n\n").hexdigest()
    assert (got[1]["loss_chars"], got[2]["n_turns"], got[None]["n_turns"]) == (0, 2, 1)
    assert chat.format_conversations(turns.limit(0)).collect() == []


# Pages


class Reader(HTMLParser):
    """The article's blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_given_pages(spark, run):
    import duckdb

    folder = "/root/testdata/sf0.01"
    expected = {}
    for page, url, source in duckdb.sql(f"SELECT * FROM '{folder}/pages.parquet'").fetchall():
        reader = Reader()
        reader.feed(source)
        reader.close()
        text = "\n".join(b for b in (" ".join(b.split()) for b in reader.blocks) if b)
        expected[page] = (url, text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in run("op6_page_text", folder).collect()}
    assert got == expected


BODY = "<p>" + "Long first paragraph of the story with some words. " * 3 + "</p>\n<p>Short &amp; sweet\n  line</p><p>" + "More &eacute; text here. " * 5 + "</p>"
STORY = [html.unescape(re.sub("<[^>]+>", "", x)).strip() for x in BODY.split("</p>") if x.strip()]
STORY = "\n".join(" ".join(x.split()) for x in STORY)
PAGES = {
    "plain": f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div id=story>{BODY}</div><div class='site-footer'>c 2020</div></body></html>",
    "comments": f"<body><article>{BODY}<div class='comments'><p>{'first! ' * 40}</p></div></article></body>",
    "notice": f"<div class='cookie-notice'>{'We use cookies. ' * 20}</div><main>{BODY}<form><p>Subscribe</p><input></form></main>",
    "aside": f"<aside><p>{'side ' * 60}</p></aside><article><header><!-- x --></header>{BODY}<footer>by A</footer></article>",
    "script": f"<article><script>if (a < b) {{ '</p>' }}</script><style>p > a {{}}</style>{BODY}</article>",
    "unclosed": f"<div class=ad><p>buy<article>{BODY}</article>",
    "cut": f"<article>{BODY}</article><footer>&copy; 20",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    assert pages.main_text(PAGES[name]) == STORY


def test_odd_pages(spark):
    rows = [(1, "u", None), (None, None, ""), (3, "u", "<p>short</p>"), (4, "u", "<" * 5000 + "a='" * 2000), (5, "u", "<div " * 3000)]
    got = pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)))
    assert all((r["text"], r["n_chars"]) == ("", 0) for r in got.where("page_id is null or page_id in (1, 3)").collect())
    assert got.count() == 5 and got.limit(0).collect() == []


LONG = "A sentence of the real story that goes on for a while. " * 4


def test_unmarked_text_beside_articles_of_other_kinds():
    page = "<div class=entry><p>%s</p></div><section class=comments><article class=comment>First!</article></section>"
    assert pages.main_text(page % LONG) == LONG.strip()
    page = "<p>By A</p><article><p>Short</p></article><div><p>%s</p></div><aside><article>%s</article></aside>"
    assert pages.main_text(page % (LONG, LONG)) == "Short\n" + LONG.strip()


LINK = "<p><a href=x>%s</a></p>"


def test_surge_and_dive_choose_the_range_in_marked_parts():
    menu, more = "".join(LINK % f"menu {k}" for k in range(5)), "".join(LINK % f"more {k}" for k in range(4))
    page = f"<article>{menu}<p>{LONG}</p>{LINK % 'amid the text'}<p>The end</p>{more}</article>"
    expected = f"{LONG.strip()}\namid the text\nThe end"
    assert pages.main_text(page) == expected
    assert pages.main_text(f"<article>{LINK % 'Linked title'}<p>{LONG}</p>{LINK % 'source'}</article>") == f"Linked title\n{LONG.strip()}\nsource"
    assert pages.main_text("<article><p>Hi.</p></article>") == "Hi."
    # A spoiled window or surge no longer finds the range.
    assert pages.main_text(page, window=1) != expected and pages.main_text(page, window=50) != expected
    late = f"<article><p>Short</p><p>x</p><p>y</p><p>{LONG}</p><p>{LONG * 3}</p><p>{LONG * 3}</p></article>"
    assert pages.main_text(late).startswith("Short") and not pages.main_text(late, surge=10**9).startswith("Short")


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<p style="overflow:hidden" title="The hidden valley">%s</p>', [LONG]),
        ("<div class='content has-sidebar'>%s</div>", [LONG]),
        ("<article><p class=ad>Buy<p>%s</p><p>More</p></article>", [LONG, "More"]),
        ("<article><ul><li class=ad>Buy<li>Real</ul><div><span class=ad>Buy</div><p>%s</article>", ["Real", LONG]),
        ("<form id=form><input><p>%s</p></form>", [LONG]),
        ("<p>%s</p><p><a href=x>a link</a></p><p>the end</p>", [LONG, "a link", "the end"]),
        ("<head><title>T</title><p>%s", [LONG]),
        ("<p hidden>no</p><p>%s</p><p aria-hidden='true'>no</p><div class='cookie-notice'>no</div>", [LONG]),
        ("<table><tr class=ad><td>Buy<tr><td>%s</table>", [LONG]),
    ],
)
def test_skipping_ends_where_the_element_does(page, expected):
    assert pages.main_text(page % LONG) == "\n".join(x.strip() for x in expected)
