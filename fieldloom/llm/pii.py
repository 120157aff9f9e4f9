"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Base spans come from four fixed patterns with checks (email, ip, card, phone) and always stay.
High-recall generators propose further, possibly overlapping spans; each gets format and context
features, boosted trees (trained here on a fixed set of labelled examples, compiled into one SQL
expression) score it, and it is redacted where its score reaches its generator's threshold,
calibrated for precision on templates that the trees are not fit to.

Defined results: null and empty texts have no spans; rows are judged one by one, so repeated rows
get equal results and an empty table an empty one; texts are read whole; further columns are
ignored. Offsets are code points, end exclusive.

Patterns are written with possessive loops and a \\G anchor: they match what the plain forms match,
but take time linear in the text and no stack.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents

_EMAIL = "[A-Za-z0-9._%+-]"
_ONCE = "(?:\\G|(?<!{0}))"


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    #: A cheap test that a text must pass before the pattern is tried.
    gate: str


BASE = (
    Pattern("email", f"{_ONCE.format(_EMAIL)}{_EMAIL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    Pattern("ip", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "."),
    Pattern("card", "[0-9](?:[\\x20-]?[0-9])++", ""),
    Pattern("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "+"),
)
#: High-recall generators of further spans; the trees decide.
GENERATORS = (
    Pattern("email_words", "[A-Za-z0-9._%+-]{1,64}+\\x20?[(\\[]at[)\\]]\\x20?[A-Za-z0-9-]{1,64}+(?:\\x20?(?:\\.|[(\\[]dot[)\\]])\\x20?[A-Za-z0-9-]{1,64}+){1,4}+", "at"),
    Pattern("phone_local", "\\(?[0-9]{2,4}\\)?[\\x20.-][0-9]{3,4}[\\x20.-][0-9]{3,4}(?![0-9])", ""),
    Pattern("id_number", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    Pattern("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}+(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ""),
)
CONTEXT = 24
CUES = "(?i)(phone|tel|call|mobile|fax|mail|contact|ssn|social|passport|iban|account|konto|compte|cuenta)"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is read."""
    return F.get(F.transform(F.array(value), use), 0)


def running(items: Column, advance: Callable, emit: Callable, kind: str, keep: Callable | None = None) -> Column:
    """emit(at, x) of each item x in order, or of those that keep(x) holds for; `at` is an int that begins
    as 0 and moves to advance(at, x) after x. `kind` is the SQL type of what is emitted.

    An append copies its list, so lists grow in groups of about the square root of their number:
    n items cost n ** 1.5 copies of references, not n ** 2.
    """
    begin = lambda at, of: F.struct(at.alias("at"), F.expr(f"cast(array() as array<{of}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.array_append(acc["out"], emit(acc["at"], x))
        return F.struct(advance(acc["at"], x).alias("at"), (more if keep is None else F.when(keep(x), more).otherwise(acc["out"])).alias("out"))

    def grouped(every: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(every))).cast("int"))
        last = F.greatest(F.floor((F.size(every) - 1) / size).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(every, g * size + 1, size))

    def folded(groups: Column) -> Column:
        past = lambda acc, g: F.struct(F.aggregate(g, acc["at"], advance).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        starts = F.aggregate(groups, begin(F.lit(0), "int"), past, lambda acc: acc["out"])
        return F.flatten(F.zip_with(groups, starts, lambda g, at: F.aggregate(g, begin(at, kind), step, lambda acc: acc["out"])))

    return _bound(_bound(items, grouped), folded)


def spans(text: Column, p: Pattern, check=None) -> Column:
    """Leftmost non-overlapping matches as structs (a, m): start and matched text. Two passes of one
    pattern give the pieces between matches and the matches; starts are their running lengths. Matches
    that fail the check are passed over before a list is made, so that many of them cost no copies."""
    pieces, found = F.split(text, p.regex), F.regexp_extract_all(text, F.lit(p.regex), 0)
    pairs = F.zip_with(pieces, found, lambda before, m: F.struct(F.length(before).alias("gap"), m.alias("m")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    return running(
        pairs,
        lambda at, x: at + x["gap"] + F.length(x["m"]),
        lambda at, x: F.struct((at + x["gap"]).alias("a"), x["m"].alias("m")),
        "struct<a:int,m:string>",
        check and (lambda x: check(x["m"])),
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn sum."""
    d = F.split(F.reverse(_digits(m)), "")
    value = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int") + 1)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check a base match must pass."""
    n = F.length(_digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, "\\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) > 3) | (F.coalesce(F.try_to_number(F.right(x, F.lit(9)), F.lit("999999999")), F.lit(0)) > 255))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(df: DataFrame) -> DataFrame:
    """Adds an array column of (a, m) for each base kind."""
    none = F.expr("cast(array() as array<struct<a:int,m:string>>)")
    for p in BASE:
        gate = F.contains("text", F.lit(p.gate)) if p.gate else F.col("text").rlike("[0-9][\\x20-]?[0-9]")
        df = df.withColumn(p.kind, F.when(gate, spans(F.col("text"), p, None if p.kind == "email" else lambda m, kind=p.kind: valid(kind, m))).otherwise(none))
    return df


# --- boosted trees -------------------------------------------------------------------------

FEATURES = ("digits", "letters", "length", "blanks", "marks", "cue", "glued_left", "glued_right", "distinct", "generator")


def python_features(generator: int, m: str, before: str, after: str) -> list[float]:
    """The features of one candidate; `column_features` computes the same in Spark."""
    return [
        float(sum(c in "0123456789" for c in m)),
        float(len(re.findall("[A-Za-z]", m))),
        float(len(m)),
        float(m.count(" ")),
        float(len(re.findall("[().\\[\\]-]", m))),
        float(bool(re.search(CUES, before))),
        float(bool(re.search("[A-Za-z0-9.+/#$-]$", before))),
        float(bool(re.search("^[A-Za-z0-9/#$%-]", after))),
        float(len(set(re.sub("[^0-9A-Z]", "", m)))),
        float(generator),
    ]


def column_features(generator: int, m: Column, before: Column, after: Column) -> dict[str, Column]:
    only = lambda keep: F.length(F.regexp_replace(m, keep, "")).cast("double")
    kinds = F.size(F.filter(F.array_distinct(F.split(F.regexp_replace(m, "[^0-9A-Z]", ""), "")), lambda x: x != ""))
    return {
        "digits": only("[^0-9]"),
        "letters": only("[^A-Za-z]"),
        "length": F.length(m).cast("double"),
        "blanks": only("[^ ]"),
        "marks": only("[^().\\[\\]-]"),
        "cue": before.rlike(CUES).cast("double"),
        "glued_left": before.rlike("[A-Za-z0-9.+/#$-]$").cast("double"),
        "glued_right": after.rlike("^[A-Za-z0-9/#$%-]").cast("double"),
        "distinct": kinds.cast("double"),
        "generator": F.lit(float(generator)),
    }


@dataclass(frozen=True)
class Template:
    """A form of candidates of one generator: its text, what stands before and after it, and whether it is personal.
    Written with # for a digit, @ for a capital, ~ for a word; alternatives are drawn from tuples."""

    generator: int
    text: str
    before: tuple[str, ...]
    after: tuple[str, ...]
    personal: int
    #: Trees are fit to the first part, thresholds calibrated on the second; neither sees the test part.
    part: str = "fit"


_CALL = ("call ", "phone: ", "tel. ", "my mobile is ", "contact ")
_END = (" ", ".", ",")
TEMPLATES = (
    Template(0, "~.~ (at) ~.com", ("~ ", "mail ", "write to "), (" ", "."), 1),
    Template(0, "~[at]~ [dot] org", ("~ ", "contact: "), (" ", ","), 1),
    Template(0, "~ (at) ##.##", ("~ ", "sold "), (" ", "."), 0),
    Template(0, "# [at] ###.##", ("~ ",), (" each",), 0),
    Template(0, "~.~(at)~(dot)~(dot)de", ("~ ", "e-mail: "), (" ", ")"), 1, "calibrate"),
    Template(0, "## (at) #.##", ("~ ",), (" ", ","), 0, "calibrate"),
    Template(1, "(###) ###-####", _CALL, _END, 1),
    Template(1, "###-###-####", _CALL, _END, 1),
    Template(1, "#### ### ####", ("fax ", "tel "), _END, 1),
    Template(1, "(##) #### ####", _CALL, _END, 1),
    Template(1, "### ### ####", _CALL, _END, 1),
    Template(1, "####.###.###", _CALL, _END, 1),
    Template(1, "## ### ###", ("~ ",), (" km", " "), 0),
    Template(1, "####-###-###", ("~ ",), _END, 0),
    Template(1, "####.####.####", ("~ ",), _END, 0),
    Template(1, "### ### ###", ("~ ",), (" ",), 0),
    Template(1, "####.###.####", ("~ v", "~ "), (" ", "-"), 0),
    Template(1, "#### #### ####", ("~ #### ",), (" ####",), 0),
    Template(1, "###-###-####", ("~ ##-",), ("-##",), 0),
    Template(1, "###.###.####", _CALL, _END, 1, "calibrate"),
    Template(1, "## #### ####", ("fax: ", "telephone "), _END, 1, "calibrate"),
    Template(1, "####-###-###", ("order ", "isbn "), _END, 0, "calibrate"),
    Template(1, "## ### ###", ("total ", "about "), (" euro", " "), 0, "calibrate"),
    Template(2, "###-##-####", ("ssn ", "social security ", "ssn: "), (" ", "."), 1),
    Template(2, "###-##-####", ("~ ", "~ ~ "), (" ", "."), 0),
    Template(2, "###-##-####", ("SSN is ", "Social: "), (",", ";"), 1, "calibrate"),
    Template(2, "###-##-####", ("part no. ", "ref "), (" ", ","), 0, "calibrate"),
    Template(3, "DE## #### #### #### #### ##", ("iban ", "konto ", "~ "), (" ",), 1),
    Template(3, "FR################", ("iban: ", "compte "), (" ",), 1),
    Template(3, "@@##@@@@@@@@@@@@@@@@", ("~ ",), (" ",), 0),
    Template(3, "@@## @@@@ @@@@ @@@@", ("~ ", "key "), (" ",), 0),
    Template(3, "NL## @@@@ #### #### ##", ("iban ", "account "), (" ", "."), 1, "calibrate"),
    Template(3, "@@##@@##@@##@@##@@##", ("~ ", "serial "), (" ",), 0, "calibrate"),
    Template(0, "~-~ [at] ~.co.uk", ("~ ", "reach me: "), (" ", "."), 1, "test"),
    Template(0, "# (at) #.#.#", ("~ ", "build "), (" ", ","), 0, "test"),
    Template(1, "(##) ### ####", ("cell: ", "mobile "), _END, 1, "calibrate"),
    Template(1, "#### ### ###", ("ring ", "phone "), _END, 1, "calibrate"),
    Template(1, "####.####.####", ("serial ", "~ "), _END, 0, "calibrate"),
    Template(1, "#### ### ###", ("code ", "item "), _END, 0, "calibrate"),
    Template(1, "###.###.###", ("fax ", "my phone: "), _END, 1, "test"),
    Template(1, "(####) ### ####", ("call me on ", "tel: "), _END, 1, "test"),
    Template(1, "###-####-###", ("sku ", "~ "), _END, 0, "test"),
    Template(1, "##.####.####", ("version ", "~ "), _END, 0, "test"),
    Template(2, "###-##-####", ("my social is ", "SSN "), (" ", "."), 1, "test"),
    Template(2, "###-##-####", ("lot ", "~ "), ("/", " "), 0, "test"),
    Template(3, "GB## @@@@ #### #### #### ##", ("iban: ", "pay to "), (" ", "."), 1, "test"),
    Template(3, "@@## #### #### ####", ("licence ", "~ "), (" ", ","), 0, "test"),
)


def examples(n: int = 250, seed: int = 7, part: str = "fit") -> list[tuple[list[float], int]]:
    """n labelled candidates of each template of a part."""
    r = random.Random(seed)
    marks = {"#": "0123456789", "@": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(3, 8)))
    fill = lambda form: "".join(r.choice(marks[c]) if c in marks else word() if c == "~" else c for c in form)
    out = []
    for _ in range(n):
        for t in TEMPLATES:
            if t.part == part:
                m, before, after = fill(t.text), fill(r.choice(t.before)), fill(r.choice(t.after))
                out.append((python_features(t.generator, m, before[-CONTEXT:], after[:CONTEXT]), t.personal))
    return out


def _best_split(rows: list[tuple[list[float], float, float]]) -> tuple[float, int, float] | None:
    """The feature and cut with the greatest gain of gradient sums."""
    best, g, h = None, sum(x[1] for x in rows), sum(x[2] for x in rows)
    for f in range(len(FEATURES)):
        sums: dict[float, list[float]] = {}
        for v, a, b in rows:
            s = sums.setdefault(v[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        keys, ga, ha = sorted(sums), 0.0, 0.0
        for low, high in zip(keys, keys[1:], strict=False):
            ga, ha = ga + sums[low][0], ha + sums[low][1]
            gain = ga * ga / (ha + 1) + (g - ga) ** 2 / (h - ha + 1) - g * g / (h + 1)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (low + high) / 2)
    return best


def _grow(rows: list[tuple[list[float], float, float]], depth: int):
    split = _best_split(rows) if depth and len(rows) > 10 else None
    if split is None or split[0] < 1e-6:
        return 0.4 * sum(x[1] for x in rows) / (sum(x[2] for x in rows) + 1)
    _, f, cut = split
    return f, cut, _grow([x for x in rows if x[0][f] <= cut], depth - 1), _grow([x for x in rows if x[0][f] > cut], depth - 1)


def score(trees: tuple, x: list[float]) -> float:
    total = 0.0
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        total += t
    return total


@cache
def model(rounds: int = 12, depth: int = 3, precision: float = 0.95) -> tuple[tuple, tuple[float, ...]]:
    """Trees fit to the examples, and for each generator the lowest score above 0 with the wanted precision on
    its calibration templates; infinite, so that nothing is selected, where no score has it."""
    data, held = examples(), examples(100, seed=8, part="calibrate")
    trees: list = []
    raw = [0.0] * len(data)
    for _ in range(rounds):
        rows = []
        for s, (x, y) in zip(raw, data, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((x, y - p, p * (1 - p)))
        trees.append(_grow(rows, depth))
        raw = [s + score((trees[-1],), x) for s, (x, _) in zip(raw, data, strict=True)]
    scored = [(x[-1], score(tuple(trees), x), y) for x, y in held]
    return tuple(trees), tuple(_threshold([(s, y) for g, s, y in scored if g == n], precision) for n in range(len(GENERATORS)))


def _threshold(scored: list[tuple[float, int]], precision: float) -> float:
    """The lowest score above 0 from which on the share of personal examples reaches the precision."""
    best = math.inf
    for cut in {s for s, _ in scored if s > 0}:
        chosen = [y for s, y in scored if s >= cut]
        if sum(chosen) >= precision * len(chosen):
            best = min(best, cut)
    return best


def selected(trees: tuple, thresholds: tuple[float, ...], x: list[float]) -> bool:
    """Whether the trees select a candidate with these features."""
    return score(trees, x) >= thresholds[int(x[-1])]


def compiled(trees: tuple, features: dict[str, Column]) -> Column:
    """The trees as one expression."""
    names = list(features)

    def leaf(t) -> Column:
        return F.when(features[names[t[0]]] <= t[1], leaf(t[2])).otherwise(leaf(t[3])) if isinstance(t, tuple) else F.lit(float(t))

    total = F.lit(0.0)
    for t in trees:
        total = total + leaf(t)
    return total


def further_spans(df: DataFrame) -> DataFrame:
    """Adds `more`: structs (kind, a, b) of the candidates that the trees select and no base span overlaps."""
    trees, thresholds = model()
    none = F.expr("cast(array() as array<struct<kind:string,a:int,b:int>>)")
    parts = []
    for n, p in enumerate(GENERATORS):
        gate = F.contains("text", F.lit(p.gate)) if p.gate else F.lit(True)
        found = F.when(gate & F.col("text").rlike(p.regex), spans(F.col("text"), p))
        df = df.withColumn(f"_c{n}", found)
        # The features of a candidate are bound before the trees read them again and again.
        df = df.withColumn(f"_f{n}", _featured(n))
        parts.append(F.coalesce(_selected(n, p, trees, thresholds[n]), none))
    return df.withColumn("more", F.concat(*parts)).drop(*[f"_{c}{n}" for c in "cf" for n in range(len(GENERATORS))])


def _featured(n: int) -> Column:
    def of(x: Column) -> Column:
        end = x["a"] + F.length(x["m"])
        before = F.substring("text", F.greatest(x["a"] - CONTEXT, F.lit(0)) + 1, F.least(x["a"], F.lit(CONTEXT)))
        after = F.substring("text", end + 1, F.lit(CONTEXT))
        made = column_features(n, x["m"], before, after)
        return F.struct(x["a"].alias("a"), end.alias("b"), *[c.alias(k) for k, c in made.items()])

    return F.transform(f"_c{n}", of)


def _selected(n: int, p: Pattern, trees: tuple, threshold: float) -> Column:
    base = F.concat(*[F.col(x.kind) for x in BASE])
    clear = lambda x: ~F.exists(base, lambda o: (o["a"] < x["b"]) & (o["a"] + F.length(o["m"]) > x["a"]))
    good = F.filter(f"_f{n}", lambda x: (compiled(trees, {k: x[k] for k in FEATURES}) >= threshold) & clear(x))
    return F.transform(good, lambda x: F.struct(F.lit(p.kind).alias("kind"), x["a"].alias("a"), x["b"].alias("b")))


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, text, an array (kind, a, b) of base spans by kind then start, and of `more`, for each row of docs."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = further_spans(base_spans(df))
    return df.select("doc_id", "text", *[p.kind for p in BASE], F.concat(*[_tagged(p.kind) for p in BASE]).alias("base"), "more")


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["a"].alias("a"), (x["a"] + F.length(x["m"])).alias("b")))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "█") -> DataFrame:
    """doc_id and the text with every selected span replaced by as many mask characters."""
    found = find_personal(docs)
    all_spans = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))

    def piece(at: Column, x: Column) -> Column:
        a = F.greatest(at, x["a"])
        return F.concat(F.substring("text", at + 1, a - at), F.repeat(F.lit(mask), F.greatest(x["b"] - a, F.lit(0))))

    pieces = running(all_spans, lambda at, x: F.greatest(at, x["b"]), piece, "string")
    end = F.coalesce(F.array_max(F.transform(all_spans, lambda x: x["b"])), F.lit(0))
    return found.select("doc_id", F.concat(F.array_join(pieces, ""), F.substring("text", end + 1, F.length("text"))).alias("text"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(documents(spark, sf_dir))
    counts = [F.size(p.kind).cast("long").alias(f"n_{p.kind}") for p in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
