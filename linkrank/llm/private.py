"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is Spark column expressions. Positions come from cutting the text at the matches: the
lengths of pieces and matches, added up, are the ends of the matches. Repetition over groups is
possessive wherever nothing could be given back, so that long runs need neither time nor stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm.registry import query
from linkrank.llm.stages import read, whole_text

NEAR = 48  #: characters before and after a span that count as nearby
CLAUSE = r"^[^,;.\n]*"  #: of those after it; what follows then speaks of something else
THRESHOLD = 0.6
_BLOCK = 256


# Characters of an account number by country, from the public IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
#: A match ends with the country's length, so a code or currency after the number is no part of it.
IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  #: a text without a match of this holds no span; cheaper than the pattern
    score: float
    confirmed: Callable[[Column], Column] | None = None  #: gets the match
    nearby: str | None = None  #: lower-case pattern of words that raise the score
    raised: float = 0.0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _code(text: Column, i: Column) -> Column:
    return F.ascii(F.substring(text, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        value = _code(digits, F.length(digits) + 1 - i) - 48
        twice = F.when(value > 4, value * 2 - 9).otherwise(value * 2)
        return total + F.when(i % 2 == 1, value).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(number: Column) -> Column:
    """ISO 7064 check of an account number without spaces: four first letters last, letters as 10 to 35."""
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = _code(turned, i)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: In the order of results; the first four are the base kinds.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.9,
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.8, lambda x: x.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.9, _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.8, lambda x: F.length(_digits(x)).between(9, 15)),
    Kind(
        "iban",
        f"(?=[A-Z]{{2}}[0-9])(?:{IBAN})",  # most places fail at the first look, before any country is tried
        "",
        0.7,
        lambda x: mod97(F.replace(x, F.lit(" "), F.lit(""))),
        "iban|konto|account|compte|cuenta",
        0.2,
    ),
    Kind(
        "ssn",
        r"[0-9]++(?:-[0-9]++)++",
        "-",
        0.4,
        lambda x: x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~x.rlike(r"^(?:000|666|9)"),
        "ssn|social security|tax",
        0.4,
    ),
    Kind(
        "secret",
        r"[0-9A-Za-z]{32,}",
        "",
        0.3,
        lambda x: x.rlike("[0-9]") & (x.rlike("^[0-9A-Fa-f]{32,64}$") | (F.length(x) <= 128) & x.rlike("[a-z]") & x.rlike("[A-Z]")),
        "token|secret|key|passw|pwd|credential",
        0.5,
    ),
)
BASE = ("email", "ip", "card", "phone")


def _ends(advances: Column) -> Column:
    """Running sums of an array; filled block by block, so that the copies stay short."""
    longs = "array<int>"
    zero = F.struct(
        F.lit(0).alias("total"), F.array().cast(longs).alias("block"), F.array().cast(f"array<{longs}>").alias("done")
    )

    def add(a: Column, x: Column) -> Column:
        total, full = a["total"] + x, F.size(a["block"]) >= _BLOCK
        block = F.when(full, F.array(total)).otherwise(F.concat(a["block"], F.array(total)))
        done = F.when(full, F.concat(a["done"], F.array(a["block"]))).otherwise(a["done"])
        return F.struct(total.alias("total"), block.alias("block"), done.alias("done"))

    return F.aggregate(advances, zero, add, lambda a: F.flatten(F.concat(a["done"], F.array(a["block"]))))


def _spans(text: Column, hits: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind: kind, start, end, score; ``hits`` are all matches in order."""
    between = F.split(text, kind.pattern, -1)
    advances = F.zip_with(between, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
    found = F.zip_with(
        hits,
        F.slice(_ends(advances), F.lit(1), F.size(hits)),
        lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")),
    )
    if kind.confirmed:
        found = F.filter(found, lambda s: kind.confirmed(s["hit"]))

    def scored(s: Column) -> Column:
        score = F.lit(kind.score)
        if kind.nearby:
            first = F.greatest(s["start"] - NEAR, F.lit(0))
            before, after = F.substring(text, first + 1, s["start"] - first), F.substring(text, s["end"] + 1, F.lit(NEAR))
            after = F.regexp_extract(after, CLAUSE, 0)
            near = F.lower(F.concat_ws("\n", before, after))
            score = score + F.when(near.rlike(kind.nearby), F.lit(kind.raised)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score")
        )

    return F.filter(F.transform(found, scored), lambda s: s["score"] >= THRESHOLD)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_spans(docs: DataFrame, text: str, into: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add a column of spans, by kind in the order of ``KINDS`` and then by start.

    Starts and ends count code points, the end is exclusive. A NULL text has no spans.
    """
    whole = whole_text(text)
    hits = {k.name: F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0)) for k in kinds}
    none = F.array().cast("array<string>")
    found = docs.withColumns(
        {
            f"_hits_{k.name}": F.when(F.contains(whole, F.lit(k.needs)), hits[k.name]).otherwise(none)
            for k in kinds
        }
    )
    empty = F.array().cast(_SPAN)
    spans = [
        F.when(F.size(f"_hits_{k.name}") > 0, _spans(whole, F.col(f"_hits_{k.name}"), k).cast(_SPAN)).otherwise(empty)
        for k in kinds
    ]
    return found.withColumn(into, F.concat(*spans)).drop(*[f"_hits_{k.name}" for k in kinds])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, and all spans.

    A NULL or empty text has no spans; repeated rows are reported each; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = find_spans(rows, "_text", "_spans")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    counts = [_number_of("_spans", kind).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    strings = "array<string>"
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast(strings).alias("block"), F.array().cast(f"array<{strings}>").alias("done")
    )

    def add(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(
            F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")
        )
        new = F.when(fresh, F.array(piece)).otherwise(F.array().cast(strings))
        full = F.size(a["block"]) >= _BLOCK
        block = F.when(full, new).otherwise(F.concat(a["block"], new))
        done = F.when(full, F.concat(a["done"], F.array(a["block"]))).otherwise(a["done"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), block.alias("block"), done.alias("done"))

    def finish(a: Column) -> Column:
        front = F.array_join(F.flatten(F.concat(a["done"], F.array(a["block"]))), "")
        return F.concat(front, F.substring(text, a["at"] + 1, F.length(text)))

    by_start = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(by_start), zero, add, finish)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked, and the text's length set anew where
    there is such a column. A NULL text stays NULL."""
    columns = docs.columns
    found = find_spans(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), "_text", "_spans")
    found = found.withColumn("_new", F.when(F.col("_text").isNotNull(), masked(F.col("_text"), F.col("_spans"))))
    changed = F.size("_spans") > 0
    out = []
    for name in columns:
        old = F.col("_row")[name]
        if name == text_col:
            out.append(F.when(changed, F.col("_new")).otherwise(old).alias(name))
        elif name == length_col:
            kind = docs.schema[name].dataType
            out.append(F.when(changed, F.length("_new").cast(kind)).otherwise(old).alias(name))
        else:
            out.append(old.alias(name))
    return found.select(*out)


_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(ord, kind, pat) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
  (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+'),
  (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (5, 'iban', '{IBAN}'),
  (6, 'ssn', '[0-9]+(?:-[0-9]+)+'),
  (7, 'secret', '[0-9A-Za-z]{{32,}}')
), cut AS (
  SELECT doc_id, t, ord, kind, regexp_extract_all(t, pat) AS h, string_split_regex(t, pat) AS g FROM t, kinds
), hits AS (
  SELECT doc_id, t, ord, kind, unnest(generate_series(1, len(h))) AS i, h, g FROM cut WHERE len(h) > 0
), placed AS (
  SELECT doc_id, ord, kind, h[i] AS hit, t,
         sum(length(g[i]) + length(h[i])) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e
  FROM hits
), facts AS (
  SELECT *, e - length(hit) AS s, regexp_replace(hit, '[^0-9]', '', 'g') AS d,
         replace(hit, ' ', '') AS flat, substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4) AS turned
  FROM placed
), near AS (
  SELECT *, lower(substring(t, CAST(greatest(s - 48, 0) + 1 AS BIGINT), CAST(s - greatest(s - 48, 0) AS BIGINT))
              || chr(10) || regexp_extract(substring(t, CAST(e + 1 AS BIGINT), 48), '{CLAUSE}')) AS ctx
  FROM facts
), spans AS (
  SELECT doc_id, ord, kind, s, e FROM near
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(hit, '.'), lambda p: CAST('0' || p AS HUGEINT))) <= 255
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(1, length(d)), lambda j:
        CASE WHEN j % 2 = 1 THEN CAST(d[length(d) + 1 - j] AS INTEGER)
             WHEN CAST(d[length(d) + 1 - j] AS INTEGER) > 4 THEN 2 * CAST(d[length(d) + 1 - j] AS INTEGER) - 9
             ELSE 2 * CAST(d[length(d) + 1 - j] AS INTEGER) END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce(list_transform(generate_series(1, length(turned)), lambda j: ascii(turned[j])),
        lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END, 0) = 1
    WHEN 'ssn' THEN regexp_full_match(hit, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND NOT regexp_matches(hit, '^(000|666|9)')
        AND regexp_matches(ctx, 'ssn|social security|tax')
    ELSE regexp_matches(hit, '[0-9]') AND (regexp_full_match(hit, '[0-9A-Fa-f]{{32,64}}')
          OR length(hit) <= 128 AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]'))
        AND regexp_matches(ctx, 'token|secret|key|passw|pwd|credential') END
), listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY ord, s) FILTER (ord <= 4) AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY ord, s) AS spans
  FROM spans GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN listed ON t.doc_id = listed.doc_id
"""


@query("op10_private_data", _SQL)
def private_data(spark: SparkSession, folder: str) -> DataFrame:
    return report(read(spark, folder, "documents"))
