"""Operator 1: personal data in text, in built-in functions only.

Regular expressions propose spans, checks confirm them (octet range, Luhn,
digit counts, mod 97), and words nearby adjust each span's score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, exclusive_sums, restored, set_aside, table

#: Characters on each side of a span that are searched for context words.
CONTEXT_CHARS = 40
#: Least score of the kinds that the method adds; base kinds always stay.
MIN_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """What proposes and confirms one kind of span.

    Quantifiers are possessive where nothing follows that could need what
    they took, and a match may start inside a run only at the end of the last
    match, so very long runs cost time in proportion and no stack. Patterns
    open with a single character class where they can, and look behind only
    after it. ``needs`` is a string without which a text has no match.
    """

    name: str
    pattern: str
    context: str
    base: bool
    score: float
    needs: str = ""


KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"(?i)e-?mail|contact|write|correo|kontakt|courriel",
        True,
        0.8,
        "@",
    ),
    Kind(
        "ip",
        r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
        r"(?i)\bip\b|address|host|server|client|login",
        True,
        0.6,
    ),
    # A match of the base pattern is a whole chain of digits with at most one
    # separator between two of them, so the digit count can stand in the pattern.
    Kind(
        "card",
        r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
        r"(?i)card|visa|master|credit|debit|cvv|expir|karte|carte|tarjeta",
        True,
        0.7,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"(?i)phone|\btel|call|mobile|fax|cell|whatsapp|telefon|t[eé]l[eé]phone",
        True,
        0.6,
    ),
    Kind(
        "iban",
        r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        r"(?i)iban|bank|account|konto|compte|cuenta",
        False,
        0.7,
    ),
    Kind(
        "national_id",
        r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?i)\bssn\b|social security|national id|tax id",
        False,
        0.3,
    ),
)


def _mod97(value: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters moved to the end."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    codes = F.transform(
        F.sequence(F.lit(1), F.length(turned)),
        lambda i: F.ascii(F.substr(turned, i, F.lit(1))),
    )
    return F.aggregate(
        codes,
        F.lit(0),
        lambda acc, c: F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97),
    )


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
            & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255),
        )
    if kind == "card":
        return F.call_function("luhn_check", F.translate(value, " -", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        size = F.length(F.replace(value, F.lit(" "), F.lit("")))
        return size.between(15, 34) & (_mod97(value) == 1)
    if kind == "national_id":
        return ~F.rlike(value, F.lit("^(000|666|9)|-00-|-0000$"))
    return F.lit(True)


def _piece_sizes(name: str) -> Column:
    """Sizes of each gap with the match that follows it."""
    gaps = F.col(name + "_g")
    return F.transform(F.col(name + "_m"), lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))


def _spans(kind: Kind, name: str) -> Column:
    found, gaps, at = (F.col(name + x) for x in ("_m", "_g", "_s"))

    def span(m: Column, i: Column) -> Column:
        start = F.get(at, i) + F.length(F.get(gaps, i))
        near = F.concat(
            F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS))
        )
        score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.context)), 0.3).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            (start + F.length(m)).alias("end"),
            m.alias("value"),
            F.least(F.lit(1.0), score).alias("score"),
            F.lit(kind.base).alias("base"),
        )

    spans = F.filter(F.transform(found, span), lambda s: _confirmed(kind.name, s["value"]))
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``pii_spans``: array of struct(kind, start, end, value, score, base).

    Offsets are code points, ``end`` exclusive; spans stand by kind as in
    ``KINDS``, then by start. Matches of one kind are leftmost and do not
    overlap; a match that its check refuses is dropped and not retried. The
    score is the kind's own, plus 0.3 if a context word stands within 40
    characters (up to the nearest span of the same kind); base kinds stay at
    any score, added ones from 0.5. Null or empty text has no spans. Rows stay
    as they are, repeated rows included, an empty table gives none. A column of
    the added name is replaced; columns of any other name stay. No shuffle
    takes place, and time is in proportion to the text.
    """
    keep = [c for c in df.columns if c != "pii_spans"]
    names = {k.name: f"__{k.name}" for k in KINDS}
    out = set_aside(df.select(*(F.col(f"`{c}`") for c in keep)), text)
    out = out.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for k in KINDS:
        searched = F.when(F.contains(F.col("__text"), F.lit(k.needs)), F.col("__text")).otherwise("")
        out = out.withColumn(f"{names[k.name]}_m", F.regexp_extract_all(searched, F.lit(k.pattern), F.lit(0)))
    for k in KINDS:
        found = F.col(f"{names[k.name]}_m")
        gaps = F.when(F.size(found) > 0, F.split(F.col("__text"), k.pattern, -1)).otherwise(F.array(F.lit("")))
        out = out.withColumn(f"{names[k.name]}_g", gaps)
    for k in KINDS:
        out = out.withColumn(names[k.name] + "_z", _piece_sizes(names[k.name]))
        out = out.withColumn(names[k.name] + "_s", exclusive_sums(F.col(names[k.name] + "_z")))
    arrays = [_spans(k, names[k.name]) for k in KINDS]
    spans = F.concat(*arrays).alias("pii_spans")
    return restored(out.select("*", spans), [*keep, "pii_spans"], text, "pii_spans")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` of :func:`find_pii` with every span of ``text`` replaced by its kind.

    Spans are taken by their offsets. Of spans that overlap, the one that
    starts first (then the longest, then the first by kind) is replaced and the
    rest of the others after it is dropped with it. Null text stays null.
    """
    order = F.transform(
        "pii_spans",
        lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("at"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    # Spans that overlap become one stretch; the text between stretches stays.
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")
    )

    def step(body: Column, acc: Column, s: Column) -> Column:
        between = F.concat(
            F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")
        )
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.array_append(acc["parts"], between)).otherwise(acc["parts"]).alias("parts"),
        )

    def cut(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substr(F.col(text), (acc["at"] + 1).cast("int")))

    masked = bound(F.aggregate(F.array_sort(order), start, lambda acc, s: step(F.col(text), acc, s)), cut)
    return df.withColumn(text, masked)


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in ("email", "ip", "card", "phone")),
        F.sha2(_joined(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        *(count(k) for k in ("iban", "national_id")),
    )


BOUNDARY = r"\b"


def _matches_sql(kind: str, pattern: str, text: str = "t") -> str:
    """Matches of a pattern without look-around: value, start and end, from the pieces between them."""
    return f"""{kind}_found AS (
    SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, ms, gs, t FROM (
        SELECT doc_id, t, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM docs)
), {kind}_all AS (
    SELECT doc_id, t, ms[i] AS v,
           (coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s,
           length(ms[i]) AS n FROM {kind}_found
)"""


# Added kinds without look-around: an account number stands between word boundaries once "_" is no word
# character; a national number is a whole run of digits and hyphens.
OP1_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_matches_sql("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
{_matches_sql("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+")},
{_matches_sql("card", "[0-9](?:[ -]?[0-9])+")},
{_matches_sql("phone", "[+][0-9][ ().0-9-]+[0-9]")},
{_matches_sql("runs", "[0-9-]+")},
{_matches_sql("iban", BOUNDARY + "[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}" + BOUNDARY, "replace(t, '_', '-')")},
national AS (
    SELECT *, coalesce(lag(s + n) OVER w, 0) AS before, coalesce(lead(s) OVER w, length(t)) AS after
    FROM runs_all WHERE regexp_full_match(v, '[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]')
    WINDOW w AS (PARTITION BY doc_id ORDER BY s)
), spans AS (
    SELECT 1 AS o, 'email' AS kind, doc_id, s, n FROM email_all
    UNION ALL SELECT 2, 'ip', doc_id, s, n FROM ip_all
    WHERE len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
    UNION ALL SELECT 3, 'card', doc_id, s, n FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM card_all)
    WHERE length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
        CASE WHEN (length(d) - j) % 2 = 0 THEN d[j]::INT WHEN d[j]::INT > 4 THEN 2 * d[j]::INT - 9 ELSE 2 * d[j]::INT END)) % 10 = 0
    UNION ALL SELECT 4, 'phone', doc_id, s, n FROM phone_all
    WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15
    UNION ALL SELECT 5, 'iban', doc_id, s, n FROM (SELECT *, replace(v, ' ', '') AS d FROM iban_all)
    WHERE length(d) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(
        string_split(d[5:] || d[:4], ''), lambda c: CASE WHEN c >= 'A' THEN (ascii(c) - 55)::VARCHAR ELSE c END), ''), ''),
        lambda x: x::INT), lambda a, x: (a * 10 + x) % 97) = 1
    UNION ALL SELECT 6, 'national_id', doc_id, s, n FROM national
    WHERE NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') AND regexp_matches(
        substr(t, (greatest(before, s - 40) + 1)::BIGINT, (s - greatest(before, s - 40))::BIGINT) || ' '
        || substr(t, (s + n + 1)::BIGINT, (least(after, s + n + 40) - s - n)::BIGINT),
        '(?i){BOUNDARY}ssn{BOUNDARY}|social security|national id|tax id')
), texts AS (SELECT *, kind || ':' || s || ':' || (s + n) AS x FROM spans)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(x, ',' ORDER BY o, s) FILTER (WHERE o <= 4), '')) AS base_sha256,
       coalesce(string_agg(x, ',' ORDER BY o, s), '') AS spans,
       count(*) FILTER (WHERE kind = 'iban') AS n_iban, count(*) FILTER (WHERE kind = 'national_id') AS n_national_id
FROM docs d LEFT JOIN texts USING (doc_id) GROUP BY 1
"""
