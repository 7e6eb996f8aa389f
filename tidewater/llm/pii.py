"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import real_id, texts

#: Proposing expressions, base kinds first; fixed values. Possessive repeats and the starts allowed by the look-behind change no
#: match: a run of local-part characters or digits can only match from its first one or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, what a context word adds within WINDOW characters, and the least score of a kind that is not a base one.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BONUS, WINDOW, LEAST = 0.3, 40, 0.5
CONTEXT = {
    "email": ["mail", "contact", "write"],
    "ip": ["address", "host", "server", "login"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["call", "phone", "tel", "mobile"],
    "iban": ["iban", "account", "bank", "transfer"],
    "ssn": ["ssn", "social", "security", "insurance"],
}


#: What a text must contain to be searched for a kind at all.
NEEDS = {"email": "@", "phone": "+"}


def _split(text: Column, kind: str) -> dict[str, Column]:
    """The leftmost non-overlapping matches of a kind and the gaps around them; none of either where nothing can match."""
    able = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    matches = F.when(able, F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})"), F.lit(1)))
    return {f"__m_{kind}": matches, f"__g_{kind}": F.when(able, F.split(text, PATTERNS[kind], -1))}


#: Matches whose positions are summed up together, and characters of a piece of text from which context is taken.
TOGETHER, PIECE = 512, 128


def _runs(kind: str) -> Column:
    """Runs of TOGETHER matches of a kind: array<struct<at, out>>, out with positions from the start of the run, at the run's length.

    The lengths of gaps and matches add up to the positions. An array grows within a run only, so the work is linear in the number of matches.
    """
    zipped = F.col(f"__z_{kind}")
    empty = F.expr("cast(array() as array<struct<start:int, end:int, match:string>>)")

    def grown(run: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["g"])
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("out"))

        return F.aggregate(run, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    n = F.ceil(F.size(zipped) / TOGETHER).cast("int")
    return F.when(F.size(zipped) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: grown(F.slice(zipped, k * TOGETHER + 1, TOGETHER))))


def found(kind: str) -> Column:
    """array<struct<start, end, match>> in code points, end exclusive, from the runs of _runs()."""
    runs = F.col(f"__r_{kind}")
    empty = F.expr("cast(array() as array<struct<start:int, end:int, match:string>>)")
    begin = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    moved = lambda r, at: F.transform(r["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["match"].alias("match")))
    return F.coalesce(F.flatten(F.zip_with(runs, begin, moved)), empty)


def _cut_out(low: Column, high: Column) -> Column:
    """The text's characters from low up to high, at most PIECE of them, from the pieces that they lie in."""
    k = F.floor(low / PIECE).cast("int")
    part = lambda i: F.coalesce(F.get("__pieces", i), F.lit(""))
    return F.concat(part(k), part(k + 1)).substr(low - k * PIECE + 1, high - low)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    chars = F.reverse(F.split(digits, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces passes ISO 7064's mod-97 check."""
    turned = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def confirmed(match: Column, kind: str) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans(kind: str, order: int) -> Column:
    """array<struct<start, kind_no, end, kind, score>> of the confirmed spans of one kind."""
    near = "|".join(CONTEXT[kind])

    def scored(x: Column) -> Column:
        around = F.lower(F.concat(_cut_out(F.greatest(F.lit(0), x["start"] - WINDOW), x["start"]), F.lit(" "), _cut_out(x["end"], x["end"] + WINDOW)))
        score = F.lit(SCORES[kind]) + F.when(around.rlike(near), BONUS).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(order).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), score).alias("score"))

    kept = F.transform(F.filter(found(kind), lambda x: confirmed(x["match"], kind)), scored)
    return kept if kind in BASE else F.filter(kept, lambda x: x["score"] >= LEAST)


def _searched(df: DataFrame, text: Column) -> DataFrame:
    """df with its spans in `found`. Every expression runs once over the text, in a projection of its own."""
    parts = {name: c for kind in PATTERNS for name, c in _split(text, kind).items()}
    some = [F.size(f"__r_{kind}") > 0 for kind in PATTERNS]
    pieces = F.when(F.coalesce(F.greatest(*some), F.lit(False)), F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1)))
    every = [spans(kind, i) for i, kind in enumerate(PATTERNS)]
    zipped = {f"__z_{k}": F.arrays_zip(F.col(f"__m_{k}").alias("m"), F.slice(f"__g_{k}", 1, F.greatest(F.lit(0), F.size(f"__m_{k}"))).alias("g")) for k in PATTERNS}
    runs = {f"__r_{kind}": _runs(kind) for kind in PATTERNS}
    return df.withColumns(parts).withColumns(zipped).drop(*parts).withColumns(runs).drop(*zipped).withColumn("__pieces", pieces).withColumn("found", F.sort_array(F.concat(*every))).drop(*runs, "__pieces")


def _joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) with found array<struct<start, kind_no, end, kind, score>>, by start, then kind.

    Base kinds (email, ip, card, phone) stay whatever their score; others need LEAST. Null and empty texts have no
    spans; texts of any length are searched whole; spans of several kinds that start together go by kind; repeated rows are searched
    each, a null id stays null; an empty table gives an empty one; other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    return _searched(rows, F.col("text")).select(real_id("id").alias("doc_id"), "found")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other, top_score) from find_personal_data()."""
    got = find_personal_data(docs, id_col, text_col)
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind_no"] < len(BASE))
    return got.select(
        "doc_id",
        *map(of, BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["kind_no"] >= len(BASE))).cast("long").alias("n_other"),
        F.array_max(F.transform("found", lambda x: x["score"])).alias("top_score"),
    )


def _taken(found: Column) -> Column:
    """The spans that count, in order: those that start at or after the end of the last one that does. Arrays grow within runs of TOGETHER spans only."""
    empty = F.expr("cast(array() as array<struct<start:int, end:int, kind:string>>)")
    n = F.ceil(F.size(found) / TOGETHER).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.slice(found, k * TOGETHER + 1, TOGETHER), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    step = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))
    within = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), empty.alias("out")), step)
    out = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int, end:int, kind:string>>>)").alias("out")),
        lambda acc, run: F.struct(within(run, acc["at"])["at"].alias("at"), F.concat(acc["out"], F.array(within(run, acc["at"])["out"])).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(found) > 0, out).otherwise(empty)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; of overlapping spans the earlier, then the earlier kind counts.

    Null texts stay null, empty and clean ones as they are; texts of any length are redacted whole, in time linear in the text; rows keep their number and
    all their columns, whatever these are called; an empty table gives an empty one.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column of docs can clash with those made here
    column = f"c{names.index(text_col)}"
    x = _searched(own, F.coalesce(column, F.lit(""))).withColumn("taken", _taken(F.col("found"))).drop("found")
    # gaps are disjoint, so cutting all of them out of the pieces takes each piece once, or twice at the borders
    pieces = F.when(F.size("taken") > 0, F.regexp_extract_all(column, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1)))
    x = x.withColumn("pieces", pieces)

    def gap(low: Column, high: Column) -> Column:
        k = F.floor(low / PIECE).cast("int")
        some = F.array_join(F.slice("pieces", k + 1, F.floor((high - 1) / PIECE).cast("int") - k + 1), "")
        return F.when(high > low, some.substr(low - k * PIECE + 1, high - low)).otherwise("")

    before = lambda i: F.when(i == 0, 0).otherwise(F.get("taken", i - 1)["end"])
    parts = F.transform("taken", lambda t, i: F.concat(gap(before(i), t["start"]), F.lit("["), t["kind"], F.lit("]")))
    done = F.concat(F.array_join(parts, ""), gap(F.element_at("taken", -1)["end"], F.length(column)))
    return x.withColumn(column, F.when(F.size("taken") > 0, done).otherwise(F.col(column))).drop("taken", "pieces").toDF(*names)
