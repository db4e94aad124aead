"""Personal data by weak supervision, with DataFrame expressions only.

Patterns propose spans, and five labelers vote on each: a strict format, a checksum or range, a gazetteer (top-level
domains, issuer digits, country and area codes), a context word just before, and clean edges. Votes are counted over
the whole corpus; expectation-maximisation on the counts estimates how reliable each labeler is, and a logistic span
classifier is trained on the resulting probabilities. It decides which further spans are added to those of the base
patterns: cards and phones that run into others, addresses with the signs spelt out, masked and version 6 addresses of
hosts, cards with other separators or of 15 digits, and phone numbers without a country.

Votes of a kind have at most 32 combinations, so the driver sees at most 128 counts. Everything per document happens
inside its row: nothing is shuffled but the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5
_JOINT = "\x01"  # stands for a separator between two digits, or a dot between two label characters

# --- patterns ---------------------------------------------------------------------------------------------------
# They match what the plain definitions do. A run of one character class is taken without steps back, and a match
# begins at the start of its run (or where the last match ended), so long runs cost linear time; repeated groups are
# written as classes over joined text, since the regular expressions of the JVM recurse for every repetition of a group.

EMAIL = rf"(?:(?<![A-Za-z0-9._%+{_JOINT}-])|\G)[A-Za-z0-9._%+{_JOINT}-]++@[A-Za-z0-9-]++{_JOINT}[A-Za-z0-9{_JOINT}-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = rf"[0-9{_JOINT}]{{2,}}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# What the further sources look for: one pattern a kind, since each source lengthens the plan.
_HOST_SIGNS = r"[0-9] ?[(\[](?:\.|dot)[)\]]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"
_HOST, _DOTTED = "[A-Za-z0-9-]++", rf"{_JOINT}[A-Za-z0-9{_JOINT}-]++"
_SPELT = rf"(?:(?: ?\(dot\) ?| ?\[dot\] ?| dot ){_HOST}){{1,4}}"
HIDDEN_EMAIL = (
    rf"(?<![A-Za-z0-9._%+{_JOINT}-])[A-Za-z0-9._%+{_JOINT}-]++"
    rf"(?: ?(?:\(at\)|\[at\]) ?{_HOST}(?:{_DOTTED}|{_SPELT})| at {_HOST}{_SPELT})"
)
HIDDEN_IP = (
    r"(?<![0-9A-Za-z:])(?:[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])"
    r"|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))"
)
CARD_GROUPS = (
    rf"(?<![0-9])(?:[0-9]{{4}}{_JOINT}?[0-9]{{4}}{_JOINT}?[0-9]{{4}}{_JOINT}?[0-9]{{4}}"
    rf"|3[47][0-9]{{2}}{_JOINT}?[0-9]{{6}}{_JOINT}?[0-9]{{5}})(?![0-9])"
)
PHONE_GROUPS = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
PHONE_LOCAL = r"(?<![0-9+(./-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[./-][0-9])"

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_DOMAINS = "com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|at|ch|it"
_COUNTRIES = "1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|address|kontakt|correo|adresse",
    "ip": r"(?i)\bip\b|address|host|server|login|adresse|servidor|serveur",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta|konto",
    "phone": r"(?i)phone|tel\b|call|mobile|fax|telefon|téléphone|teléfono|anruf",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of at least one digit pass the Luhn check?"""

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _is_card(text: Column, least: int = 16, most: int = 19) -> Column:
    def check(digits: Column) -> Column:
        return F.when(F.length(digits).between(least, most), luhn(digits)).otherwise(F.lit(False))

    return _let(_digits(text), check)


@dataclass(frozen=True)
class Source:
    """A pattern that proposes spans of a kind; ``base`` spans that are valid stay whatever the classifier says.

    ``strict`` and ``listed`` are what the format and the gazetteer labeler look for, where not those of the kind.
    """

    kind: str
    pattern: str
    column: str
    base: bool
    valid: Callable[[Column], Column]
    strict: str | None = None
    listed: str | None = None


def _in_range(m: Column) -> Column:
    return m.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")


def _long_enough(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


SOURCES = (
    Source("email", EMAIL, "_mail", True, lambda m: F.lit(True)),
    Source("ip", IP, "_numbers", True, _in_range),
    Source("card", DIGITS, "_joined", True, _is_card),
    Source("phone", PHONE, "_plus", True, _long_enough),
    # "look at example dot com" is prose: with plain words for both signs, the local part must be unlike a word.
    Source(
        "email", HIDDEN_EMAIL, "_hidden", False,
        lambda m: m.rlike(rf"[(\[]at[)\]]|\A[^ ]*[._%+0-9{_JOINT}-]")
        & m.rlike(rf"{_JOINT}[A-Za-z0-9-]+\z|dot[)\]]? ?(?:{_DOMAINS})\z"),
        r"\A[A-Za-z0-9][^ ]*[ (\[]", rf"(?:{_JOINT}|dot[)\]]? ?)(?:{_DOMAINS})\z",
    ),
    Source(
        "ip", HIDDEN_IP, "_hosts", False, lambda m: m.contains(":") | _in_range(F.regexp_replace(m, "[^0-9]+", ".")),
        r"\A[1-9][^:]*\z|[0-9A-Fa-f]{3}", r"(?i)\A(?!0|127[^0-9]|255[^0-9])[^:]*\z|\A(?:2[0-9a-f]{3}|fe[89ab].|f[cd]..):",
    ),
    Source(
        "card", CARD_GROUPS, "_cards", False, lambda m: _is_card(m, 15, 16),
        rf"\A(?:[0-9]{{4}}{_JOINT}?){{3}}[0-9]{{4}}\z|\A3[47]",
    ),
    Source(
        "phone", rf"{PHONE_GROUPS}|{PHONE_LOCAL}", "_phones", False,
        lambda m: _long_enough(m) & m.rlike(r"\A(?:\+|\(?[2-9][0-9]{2}[^0-9]+[2-9])"),
        rf"\A(?:{PHONE_GROUPS}|\(|[0-9]{{3}}([.-])[0-9]{{3}}\1)", rf"\A(?:\+(?:{_COUNTRIES})|\(?[2-9](?!11))",
    ),
)


def _votes(source: Source, m: Column, before: Column, after: Column, valid: Column) -> Column:
    """The five votes as bits: format, check, gazetteer, context, edges."""
    strict, listed = {
        "email": (rf"\A[A-Za-z0-9][A-Za-z0-9._%+{_JOINT}-]*@[A-Za-z0-9{_JOINT}-]+\z", rf"{_JOINT}(?:{_DOMAINS})\z"),
        "ip": (r"\A[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}\z", r"\A(?!0|127\.|255\.)"),
        "card": (rf"\A(?:[0-9]{{4}}{_JOINT}?){{3}}[0-9]{{4}}\z", r"\A[2-6]"),
        "phone": (rf"\A{PHONE_GROUPS}\z", rf"\A\+(?:{_COUNTRIES})"),
    }[source.kind]
    strict, listed = source.strict or strict, source.listed or listed
    edges = ~before.rlike(r"[A-Za-z0-9]\z") & ~after.rlike(r"\A[A-Za-z0-9]")
    votes = [m.rlike(strict), valid, m.rlike(listed), before.rlike(_CONTEXT[source.kind]), edges]
    total = F.lit(0)
    for bit, vote in enumerate(votes):
        total = total + F.when(vote, 1 << bit).otherwise(0)
    return total


# --- spans of a row ---------------------------------------------------------------------------------------------

_CHUNK = 256


def _append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def _sums(items: Column) -> Column:
    """Running sums of an array of integers, the item itself included."""
    empty = F.array().cast("array<int>")
    return F.aggregate(
        items,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, x: F.struct((s.at + x).alias("at"), _append(s.out, s.at + x).alias("out")),
        lambda s: s.out,
    )


def running_sums(items: Column) -> Column:
    """Running sums in chunks, so that an array of a million items takes no quadratic time."""

    def chunked(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _CHUNK).cast("int")), lambda b: F.slice(s, b * _CHUNK + 1, _CHUNK))
        return _let(F.transform(chunks, _sums), with_offsets)

    def with_offsets(inner: Column) -> Column:
        ends = _sums(F.transform(inner, lambda c: F.element_at(c, -1)))
        pairs = F.arrays_zip(inner.alias("c"), F.concat(F.array(F.lit(0)), ends).alias("o"))
        shifted = F.transform(F.slice(pairs, F.lit(1), F.size(inner)), lambda p: F.transform(p.c, lambda x: x + p.o))
        return F.flatten(shifted)

    return _let(items, lambda s: F.when(F.size(s) <= _CHUNK, _sums(s)).otherwise(chunked(s)))


_SPANS = "array<struct<start:int,end:int,votes:int,valid:boolean>>"


def _proposed(source: Source) -> Column:
    """The source's spans in a row: start, end, votes, valid."""
    text, pattern = F.col(source.column), F.lit(source.pattern)

    def place(found: Column) -> Column:
        gaps = F.split(text, source.pattern, -1)

        def located(g: Column) -> Column:
            n = F.size(found)
            previous = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), n - 1))
            steps = F.zip_with(F.slice(g, F.lit(1), n), previous, lambda gap, m: F.length(gap) + F.length(m))
            rows = F.arrays_zip(
                found.alias("m"), g.alias("g"), F.slice(g, F.lit(2), n).alias("a"), running_sums(steps).alias("s")
            )

            def span(x: Column) -> Column:
                valid = source.valid(x.m)
                votes = _votes(source, x.m, F.right(x.g, F.lit(40)), F.left(x.a, F.lit(1)), valid)
                end = x.s + F.length(x.m)
                return F.struct(x.s.alias("start"), end.alias("end"), votes.alias("votes"), valid.alias("valid"))

            return F.transform(F.slice(rows, F.lit(1), n), span)

        return _let(gaps, located)

    none = F.array().cast(_SPANS)
    found = F.coalesce(F.regexp_extract_all(text, pattern, F.lit(0)), F.array().cast("array<string>"))
    return _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(place(m))).cast(_SPANS)


def with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a text column ``_text`` (null as empty) and the spans of each source, ``_c0``, ``_c1``, ...

    Texts without a sign that a source needs are not searched for it.
    """
    plain = F.translate(F.col("_text"), _JOINT, "\x02")
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOINT)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", _JOINT)
    grouped = F.regexp_replace(plain, r"(?<=[0-9])[ ./_-](?=[0-9])", _JOINT)
    base = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    searched = base.withColumns(
        {
            "_mail": F.when(F.col("_text").contains("@"), dotted),
            "_hidden": F.when(F.col("_text").rlike(r"[(\[]at[)\]]| at [A-Za-z0-9-]++ ?[(\[]?dot"), dotted),
            "_numbers": F.when(F.col("_text").rlike(r"[0-9]\.[0-9]"), F.col("_text")),
            "_joined": F.when(F.col("_text").rlike("[0-9][ -]?[0-9]"), joined),
            "_plus": F.when(F.col("_text").contains("+"), F.col("_text")),
            "_hosts": F.when(F.col("_text").rlike(_HOST_SIGNS), F.col("_text")),
            "_cards": F.when(F.col("_text").rlike("[0-9]{4}[ ./_-]?[0-9]{4}"), grouped),
            "_phones": F.when(F.col("_text").rlike(r"\+[0-9]|[0-9]{3}[ .-][0-9]{4}"), F.col("_text")),
        }
    )
    return searched.withColumns({f"_c{i}": _proposed(source) for i, source in enumerate(SOURCES)})


# --- reliabilities and classifier -------------------------------------------------------------------------------


def _field_after(first: Column, name: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(first, x[name].alias(name))


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[str, dict[int, int]]:
    """For each kind, how often each combination of votes occurs among all proposed spans."""
    found = with_candidates(docs.select(text_col), F.col(text_col))
    proposed = F.concat(
        *[
            F.transform(f"_c{i}", _field_after(F.lit(source.kind).alias("kind"), "votes")) for i, source in enumerate(SOURCES)
        ]
    )
    rows = found.select(F.explode(proposed).alias("x")).groupBy("x.kind", "x.votes").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[int, int]] = {kind: {} for kind in KINDS}
    for row in rows.collect():  # at most 32 a kind
        counts[row["kind"]][row["votes"]] = row["n"]
    return counts


def _bits(votes: int) -> list[int]:
    return [votes >> bit & 1 for bit in range(LABELERS)]


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Probability that a span with these votes is personal data, by expectation-maximisation over the vote counts.

    Labelers are taken as independent given the truth. They start as better than chance, and two imagined spans of
    each sort, with all votes and with none, keep the classes apart.
    """
    rows = {votes: float(n) for votes, n in counts.items()}
    rows[31] = rows.get(31, 0.0) + 2
    rows[0] = rows.get(0, 0.0) + 2
    share, right, wrong = 0.5, [0.8] * LABELERS, [0.2] * LABELERS
    total = sum(rows.values())

    def personal(votes: int) -> float:
        odds = log(share / (1 - share))
        for bit, yes, no in zip(_bits(votes), right, wrong):
            odds += log(yes / no) if bit else log((1 - yes) / (1 - no))
        return 1 / (1 + exp(-max(-500.0, min(500.0, odds))))

    for _ in range(rounds):
        p = {votes: personal(votes) for votes in rows}
        weight = sum(n * p[votes] for votes, n in rows.items())
        share = (weight + 1) / (total + 2)
        for k in range(LABELERS):
            ones = sum(n * p[votes] * _bits(votes)[k] for votes, n in rows.items())
            others = sum(n * (1 - p[votes]) * _bits(votes)[k] for votes, n in rows.items())
            right[k], wrong[k] = (ones + 1) / (weight + 2), (others + 1) / (total - weight + 2)
    return {votes: personal(votes) for votes in rows}


def train_classifier(counts: dict[int, int], steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier (bias first) fitted to the probabilities, each combination by its count."""
    target = reliabilities(counts)
    rows = [(_bits(votes), p, counts.get(votes, 0) + 1.0) for votes, p in target.items()]
    total = sum(n for _, _, n in rows)
    weights = [0.0] * (LABELERS + 1)
    for _ in range(steps):
        gradient = [ridge * w for w in weights]
        for bits, p, n in rows:
            z = weights[0] + sum(w * b for w, b in zip(weights[1:], bits))
            error = n / total * (1 / (1 + exp(-max(-500.0, min(500.0, z)))) - p)
            gradient[0] += error
            for k, b in enumerate(bits):
                gradient[k + 1] += error * b
        weights = [w - rate * g for w, g in zip(weights, gradient)]
    return weights


def train_on_corpus(docs: DataFrame, text_col: str = "text") -> dict[str, list[float]]:
    """The span classifier of each kind, from the votes of the whole corpus."""
    return {kind: train_classifier(counts) for kind, counts in vote_counts(docs, text_col).items()}


# --- results ----------------------------------------------------------------------------------------------------


def _accepted(weights: Sequence[float], least: float) -> Callable[[Column], Column]:
    def accept(span: Column) -> Column:
        z = F.lit(weights[0])
        for bit, weight in enumerate(weights[1:]):
            z = z + F.when(F.getbit(span.votes, F.lit(bit)) == 1, F.lit(weight)).otherwise(F.lit(0.0))
        return z >= log(least / (1 - least))

    return accept


def _edges(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))


def _apart_from(spans: Column) -> Callable[[Column], Column]:
    return lambda others: F.filter(spans, lambda a: ~F.exists(others, lambda b: (b.start < a.end) & (b.end > a.start)))


def with_spans(docs: DataFrame, classifier: dict[str, Sequence[float]], text_col: str = "text", least: float = 0.9) -> DataFrame:
    """``docs`` with the base spans of each kind (``_base_email``, ...) and all of them (``_all_email``, ...).

    A span is (start, end) in code points, the end exclusive, in order. Valid proposals of the other patterns are added
    if the classifier gives them at least probability ``least`` and they touch no base span and no span added before.
    A null text has no spans.
    """
    found = with_candidates(docs, F.col(text_col))
    valid = {i: F.filter(f"_c{i}", lambda x: x.valid) for i in range(len(SOURCES))}
    base = {source.kind: _edges(valid[i]) for i, source in enumerate(SOURCES) if source.base}
    found = found.withColumns({f"_base_{kind}": base[kind] for kind in KINDS})
    added: dict[str, list[str]] = {kind: [] for kind in KINDS}
    taken = [f"_base_{kind}" for kind in KINDS]
    for i, source in enumerate(SOURCES):
        if source.base:
            continue
        proposed, mine = f"_extra_{i}", f"_added_{i}"
        found = found.withColumn(proposed, _edges(F.filter(valid[i], _accepted(classifier[source.kind], least))))
        apart = _let(F.concat(*taken), _apart_from(F.col(proposed)))
        found = found.withColumn(mine, F.when(F.size(proposed) == 0, F.col(proposed)).otherwise(apart))
        added[source.kind].append(mine)
        taken.append(mine)
    return found.withColumns({f"_all_{kind}": F.array_sort(F.concat(f"_base_{kind}", *added[kind])) for kind in KINDS})


def _written(prefix: str) -> Column:
    """kind:start:end of the spans, by kind and start, joined by commas."""

    def write(kind: str) -> Callable[[Column], Column]:
        return lambda x: F.concat_ws(":", F.lit(kind), x.start.cast("string"), x.end.cast("string"))

    return F.concat_ws(",", F.concat(*[F.transform(prefix + kind, write(kind)) for kind in KINDS]))


def span_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of the rows of ``with_spans``."""
    return found.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        *[F.size(f"_base_{kind}").cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_written("_base_"), 256).alias("base_sha256"),
        _written("_all_").alias("spans"),
    )


def masked_text(found: DataFrame) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced together."""

    def tag(kind: str) -> Callable[[Column], Column]:
        name = F.lit(f"[{kind.upper()}]").alias("tag")
        return lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), name)

    tagged = F.concat(*[F.transform(f"_all_{kind}", tag(kind)) for kind in KINDS])
    text = F.col("_text")

    def replace(s: Column, x: Column) -> Column:
        gap = F.substring(text, s.at + 1, F.greatest(x.start - s.at, F.lit(0)))
        part = F.when(x.start >= s.at, F.concat(gap, x.tag)).otherwise(F.lit(""))
        return F.struct(F.greatest(s.at, x.end).alias("at"), _append(s.out, part).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def close(s: Column) -> Column:
        return F.concat(F.concat_ws("", s.out), F.substring(text, s.at + 1, F.length(text)))

    return _let(F.array_sort(tagged), lambda t: F.when(F.size(t) == 0, text).otherwise(F.aggregate(t, start, replace, close)))


def without_personal_data(docs: DataFrame, classifier: dict[str, Sequence[float]], text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind; all columns keep name, type and, but for the text, value.

    The row goes along as one struct, so no column can meet a working column of ``with_spans``. A null text becomes
    the empty one.
    """
    packed = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    found = with_spans(packed, classifier)
    masked = masked_text(found)
    return found.select(
        *[masked.alias(name) if name == text_col else F.col("row").getField(name).alias(name) for name in docs.columns]
    )
