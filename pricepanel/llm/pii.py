"""Personal data in text (operator 4), by Spark SQL functions alone.

Regular expressions propose spans, validators confirm them (octets, Luhn, mod-97,
digit counts), and context words before a span adjust its score. Kinds:

``email ip card phone``   the base kinds; a confirmed span always stays
``iban``                  two letters, two check digits, 11 to 30 letters or digits; mod-97 must be 1
``ssn``                   ddd-dd-dddd with an allowed area, group and serial; stays at a score of 0.5
                          or more, which a context word gives

A span is (kind, start, end, score) in code points, end exclusive; spans of a kind don't overlap, those of
different kinds may. Null and empty texts have no span. Patterns use possessive
loops and start conditions that make them linear on long runs of digits or letters;
they match what the plain forms in the comments match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricepanel.llm.common import OWN

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a match starts where a run starts or a match has ended
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits; the plain form takes a whole run, so a longer one has no match
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}

#: Score of a confirmed span, and what a context word adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
BOOST = 0.1
LEAST = {"ssn": 0.5}
#: Context is looked for in so many code points before a span, back to the kind's span before it.
NEAR = 40
#: Matches per block of the running sums.
RUN = 64
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "insurance"),
}


def _octets(m: Column) -> Column:
    """All four numbers are at most 255; leading zeros don't count."""
    return F.forall(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(F.transform(F.split(_digits(m), ""), lambda x: F.coalesce(x.cast("int"), F.lit(-1))))
    digits = F.filter(d, lambda x: x >= 0)
    value = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(m: Column) -> Column:
    """The first four letters go to the end, letters count from 10, and the number leaves 1 mod 97."""
    turned = F.concat(F.substring(m, 5, 64), F.substring(m, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), step) == 1


CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,size:int,m:string,near:string>>")


def _proposed(text: Column, kind: str) -> Column:
    """All matches of a kind with their starts: a match starts after the texts
    between matches and the matches before it."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern), F.lit(1), F.greatest(F.size(found), F.lit(0)))
    lengths = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), m.alias("m"), F.lower(F.substring(b, -NEAR, NEAR)).alias("near")))

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["gap"] + x["size"])

    # Running sums in two levels, so that they stay near linear in a text with very many matches.
    def starts(ls: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(ls) / RUN).cast("int")), lambda b: total(F.slice(ls, b * RUN + 1, RUN)))
        return _let(blocks, lambda sums: _let(
            F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, x: a + x)),
            lambda base: F.transform(ls, lambda x, i: F.struct(
                (F.get(base, (i / RUN).cast("int")) + total(F.slice(ls, i - i % RUN + 1, i % RUN)) + x["gap"]).alias("start"),
                x["size"].alias("size"),
                x["m"].alias("m"),
                x["near"].alias("near"),
            )),
        ))

    return F.when(F.size(lengths) > 0, _let(lengths, starts)).otherwise(_none())


def _confirmed(proposed: Column, kind: str) -> Column:
    """The valid ones of a kind's proposals, with scores."""

    def scored(x: Column) -> Column:
        hint = F.lit(False)
        for word in CONTEXT[kind]:
            hint = hint | F.contains(x["near"], F.lit(word))
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"),
            (x["start"] + x["size"]).alias("end"),
            F.round(F.lit(SCORES[kind]) + F.when(hint, BOOST).otherwise(0.0), 2).alias("score"),
        )

    spans = F.transform(F.filter(proposed, lambda x: CONFIRM[kind](x["m"])), scored)
    return F.filter(spans, lambda x: x["score"] >= LEAST[kind]) if kind in LEAST else spans


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans array<struct<start, kind, end, score>>`` by start, then
    kind in the order of ``KINDS``. A column of that name is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "spans"])
    source = F.coalesce(F.col(text), F.lit(""))
    # Regular expressions run where their mark occurs. Numbers need a digit: one cheap test for four kinds.
    out = docs.withColumn(f"{OWN}digit", source.rlike("[0-9]"))
    for kind in KINDS:
        need = F.contains(source, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            need = need & F.col(f"{OWN}digit")
        out = out.withColumn(f"{OWN}{kind}", F.when(need, _proposed(source, kind)).otherwise(_none()))
    parts = [_confirmed(F.col(f"{OWN}{kind}"), kind) for kind in KINDS]
    spans = F.transform(
        F.array_sort(F.concat(*parts)),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["score"].alias("score")),
    )
    return out.withColumn("spans", spans).drop(f"{OWN}digit", *[f"{OWN}{k}" for k in KINDS])


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of the base kinds, a digest of the base spans, and all spans written out."""
    found = find(docs, text)
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        *docs.columns,
        *[count(k) for k in KINDS[:4]],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
