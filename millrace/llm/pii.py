"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Native: regular expressions and higher-order functions within each row; nothing is shuffled. A
span's place comes from the pieces between matches: their lengths and the matches' lengths add up to
code-point offsets. The patterns are written so that they take a step per character, without
recursion over unbounded groups, and match just what the contract's base patterns match.

Kinds: email, ip, card (Luhn), phone, and the added iban (mod-97). Each span has a base confidence;
words such as "call" or "account" within CONTEXT characters before it raise it, words such as
"version" or "order" lower it. Base kinds always stay, whatever their score. An iban needs its checksum and a score
of LEAST: it stays without a context word, as a mod-97 match is rarely chance, but not after lowering words alone.

Defined results: null text counts as empty: no spans, and the digest of the empty string. Repeated
rows give repeated results, and ties cannot occur: spans of one kind are disjoint. Very long texts are
whole: places come from chunked running sums, and redaction cuts bytes at known places, so both take steps in
proportion to a text's length and number of spans. Extra columns pass through :func:`redact`. An empty table
gives an empty table. Overlapping spans of different kinds are all reported; redaction joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
CONTEXT = 40

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
# The base patterns, each in a form that never tries a start inside a run it has refused.
PATTERNS = {
    # The end of the last match may lie inside a run of local-part characters; \G lets a match begin there.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?!{_LABEL})(?!\.{_LABEL})",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of digits with single separators are maximal, so those of 13 to 19 digits are found by their bounds.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])(?![ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for a kind to be looked for at all: a string, or else a pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
NEEDS_MATCH = {"card": "[0-9][ -]?[0-9]", "iban": "[0-9]{2}"}
CONFIDENCE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
#: What a span of an added kind must score.
LEAST = 0.7
RAISING = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|pay|master",
    "phone": "call|phone|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
}
LOWERING = {
    "email": "example|noreply",
    "ip": "version|release|chapter|section",
    "card": "order|tracking|serial|isbn",
    "phone": "order|serial|score",
    "iban": "order|serial|model",
}


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def luhn(match: Column) -> Column:
    """Whether a match has 13 to 19 digits that pass Luhn's test."""
    digits = F.reverse(F.filter(F.split(F.regexp_replace(match, "[^0-9]", ""), ""), lambda d: d != ""))

    def test(d: Column) -> Column:
        doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        values = F.transform(d, lambda x, i: F.when(i % 2 == 1, doubled(x.cast("int"))).otherwise(x.cast("int")))
        return F.size(d).between(13, 19) & (F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0)

    return let(digits, test)


def mod97(match: Column) -> Column:
    """Whether an account number of 15 to 34 characters leaves 1 by ISO 7064's test."""

    def test(s: Column) -> Column:
        turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
        chars = F.filter(F.split(turned, ""), lambda c: c != "")
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)
        return F.char_length(s).between(15, 34) & (rest == 1)

    return let(F.regexp_replace(match, " ", ""), test)


def octets(match: Column) -> Column:
    """Whether all four parts are at most 255, however many zeros they begin with."""
    return F.forall(F.split(match, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def phone_digits(match: Column) -> Column:
    return F.char_length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)


VALID = {"email": lambda m: F.lit(True), "ip": octets, "card": luhn, "phone": phone_digits, "iban": mod97}

SPAN = "array<struct<kind:string,start:int,end:int,score:double,from:int,to:int>>"
#: Items that one fold appends to an array; longer ones are folded in chunks of so many.
CHUNK = 128


def scan(items: Column, zero: Column, state: str, advance, emit, out: str) -> Column:
    """``emit(state before, item)`` of every item, the state carried along by ``advance``; not for an empty array.

    Appending copies an array, so a state is kept for every chunk, and chunks are folded apart from each other.
    """

    def chunked(all_items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(all_items) - 1, F.lit(CHUNK))
        return let(F.transform(starts, lambda s: F.slice(all_items, s + 1, CHUNK)), whole)

    def whole(chunks: Column) -> Column:
        first = F.struct(zero.alias("s"), F.array().cast(f"array<{state}>").alias("all"))
        step = lambda a, c: F.struct(F.aggregate(c, a["s"], advance).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all"))
        each = lambda a, x: F.struct(advance(a["s"], x).alias("s"), F.concat(a["out"], F.array(emit(a["s"], x))).alias("out"))
        none = F.array().cast(out).alias("out")
        apart = lambda before: F.transform(chunks, lambda c, j: F.aggregate(c, F.struct(F.get(before, j).alias("s"), none), each, lambda a: a["out"]))
        return F.flatten(let(F.aggregate(chunks, first, step, lambda a: a["all"]), apart))

    return let(items, chunked)


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order, with their scores."""
    pattern = PATTERNS[kind]

    def score(context: Column) -> Column:
        lower = F.lower(context)
        up = F.when(lower.rlike(f"(?:{RAISING[kind]})"), 0.2).otherwise(0.0)
        down = F.when(lower.rlike(f"(?:{LOWERING[kind]})"), 0.2).otherwise(0.0)
        return F.lit(CONFIDENCE[kind]) + up - down

    def place(both: Column) -> Column:
        matches, between = both["m"], both["b"]
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))

        def advance(a: Column, x: Column) -> Column:
            at, byte = (a[k] + size(x["b"]) + size(x["m"]) for k, size in (("at", F.char_length), ("byte", F.octet_length)))
            return F.struct(at.alias("at"), byte.alias("byte"))

        def span(a: Column, x: Column) -> Column:
            at, byte = a["at"] + F.char_length(x["b"]), a["byte"] + F.octet_length(x["b"])
            near = F.substring(x["b"], -CONTEXT, CONTEXT)
            values = (F.lit(kind), at, at + F.char_length(x["m"]), score(near), byte, byte + F.octet_length(x["m"]))
            made = F.struct(*[v.alias(n) for v, n in zip(values, ("kind", "start", "end", "score", "from", "to"), strict=True)])
            good = VALID[kind](x["m"])
            return F.when(good if kind in BASE_KINDS else good & (made["score"] >= LEAST), made)

        pairs = F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(between, i).alias("b")))
        spans = scan(pairs, zero, "struct<at:int,byte:int>", advance, span, SPAN)
        return F.filter(spans, lambda x: x.isNotNull())

    def found(t: Column) -> Column:
        matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        none = F.array().cast(SPAN)
        return let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.struct(m.alias("m"), F.split(t, pattern, -1).alias("b")), place)))

    wanted = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(NEEDS_MATCH[kind])
    return F.when(wanted, found(text)).otherwise(F.array().cast(SPAN))


def text_of() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, and the spans of each kind in its own column."""
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[spans_of(text, kind).alias(kind) for kind in KINDS])


def redact(docs: DataFrame) -> DataFrame:
    """Every span in ``text`` becomes <KIND>; overlapping spans become one, named by the first.

    ``n_chars`` is brought up to date; rows without spans keep theirs.
    """
    own = F.struct([F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    text = text_of()
    spans = F.sort_array(F.transform(F.concat(*[spans_of(text, kind) for kind in KINDS]), lambda s: F.struct(s["from"].alias("from"), (-s["to"]).alias("minus"), s["kind"].alias("kind"))))
    found = docs.select(own, text.alias("t"), spans.alias("spans"))
    # State: the end of what is hidden so far. A span that begins before it is part of the one before.
    cut = "struct<from:int,to:int,kind:string>"
    piece = lambda a, s: F.when(s["from"] >= a, F.struct(a.alias("from"), s["from"].alias("to"), s["kind"].alias("kind")))
    pieces = scan(F.col("spans"), F.lit(0), "int", lambda a, s: F.greatest(a, -s["minus"]), piece, f"array<{cut}>")

    def rebuilt(both: Column) -> Column:
        raw = both["raw"]  # bytes are cut without reading what is before them
        parts = F.transform(F.filter(both["pieces"], lambda x: x.isNotNull()), lambda x: F.concat(raw.substr(x["from"] + 1, x["to"] - x["from"]).cast("string"), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        end = F.aggregate("spans", F.lit(0), lambda a, s: F.greatest(a, -s["minus"]))
        return F.concat(F.array_join(parts, ""), let(end, lambda e: raw.substr(e + 1, F.octet_length(raw) - e).cast("string")))

    clean = F.when(F.size("spans") > 0, let(F.struct(F.col("t").cast("binary").alias("raw"), pieces.alias("pieces")), rebuilt))
    found = found.select("row", clean.alias("clean"))
    kinds = dict(docs.dtypes)
    new = {"text": F.coalesce(F.col("clean"), F.col("row.text").cast("string")).cast(kinds["text"])}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    return found.select([new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base spans' digest, and all spans, for rows of :func:`detect`."""
    base = F.concat(*[F.col(k) for k in BASE_KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(*[F.col(k) for k in KINDS])).alias("spans"),
        F.size("iban").cast("long").alias("n_iban"),
        F.round(F.aggregate(F.concat(*[F.col(k) for k in KINDS]), F.lit(0.0), lambda a, s: F.greatest(a, s["score"])), 3).alias("top_score"),
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``."""
    return digest(detect(spark.read.parquet(f"{sf_dir}/documents.parquet")))
