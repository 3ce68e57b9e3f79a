"""Secret scans with a battery of randomness tests (operator 8), in column functions only.

Fixed patterns give the base spans. The method adds stretches of encoded characters that look random:

1. A candidate is a whole run of the characters of an alphabet: of base 64, of its form for URLs, or of letters and digits alone, so that what
   stands behind ``NAME=``, in a path or behind a prefix is also tested by itself. ``=`` belongs to a run only as padding at its end. Its encoding
   (hexadecimal, base 32, base 36, base 64 and its form for URLs) is inferred from the characters it has and must have the length at which the tests
   have power. Runs of letters or digits alone are no candidates. Of secrets inside one another the longest stays, as a secret may hold separators;
   one inside another candidate takes it whole unless only names, like those of a path, are around it.
2. Three tests ask whether its symbols are evenly distributed: chi-squared over the alphabet, runs above and below the middle, correlation
   of neighbours. The smallest p-value, times three, is the battery's; a candidate it rejects at 0.001 is no secret.
3. Most names are too short for the battery to reject. So the null hypothesis that a discovery has to refute is: this is a name, made of words, numbers and
   separators. The kinds of its characters (vowel, consonant, capital, digit, separator) then follow one another as in names, by a fixed table, and not as in
   the encoding's alphabet. The likelihood ratio of the two is above x for at most 1/x of all names, at every length, so its inverse is a p-value without any approximation.
4. Which p-values are small enough is found per length class over the whole corpus by controlling the rate of false discoveries (Benjamini and
   Hochberg) on a histogram of p-values: of the secrets found, 5 % are names at most, by expectation, whether there are many secrets or none.

A text's runs are found and tested token by token, and places are summed up in blocks, so a text with very many candidates costs little more than in proportion to them.

Nulls: a null text is empty and has no spans. Positions are code points, ends exclusive. Texts are read whole. Repeated rows each
have their spans; an empty table gives no rows; all columns of the input stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptide.llm.common import fresh

#: What the patterns must be.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
#: Whole runs of each alphabet with the padding its encodings allow; one character that goes on after ``=`` makes that a separator.
RUNS = tuple(rf"[{letters}]{{24,}}(?:={{1,{padding}}}(?![A-Za-z0-9+/_=-]))?" for letters, padding in (("A-Za-z0-9+/", 2), ("A-Za-z0-9_-", 2), ("A-Za-z0-9", 6)))
#: What stands around a secret, between separators, and is not a part of it.
NAME, BETWEEN = r"^(?:|v[0-9]{1,3}|(?:[A-Z]?[a-z]{3,}|[A-Z]{3,})[0-9]{0,4})$", "[/_=-]+"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: pattern of a whole candidate, its alphabet, the least length. The first that fits is inferred.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$", DIGITS + LOWER[:6]),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]{32,}$", DIGITS + UPPER[:6]),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]{24,}={0,6}$", UPPER + DIGITS[2:8]),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]{24,}$", DIGITS + LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]{24,}$", DIGITS + UPPER),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]{24,}={0,2}$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]{24,}={0,2}$", UPPER + LOWER + DIGITS + "-_"),
)
#: Kinds of characters, and how one follows another (rows: the one before) in names. Fixed by hand.
VOWEL, CONSONANT, CAPITAL, DIGIT, SEPARATOR = range(5)
IN_NAMES = (
    (0.12, 0.68, 0.10, 0.05, 0.05),
    (0.45, 0.35, 0.10, 0.05, 0.05),
    (0.30, 0.35, 0.30, 0.03, 0.02),
    (0.05, 0.10, 0.15, 0.60, 0.10),
    (0.15, 0.35, 0.35, 0.14, 0.01),
)
#: Lower bounds of the length classes.
LENGTHS = (0, 32, 40, 48, 64, 96, 128, 256)
#: p-values are counted by tenths of their decimal logarithm, down to 10^-30.
STEPS = 300
#: What the battery rejects at this p-value is no secret; so many of all secrets are lost by it.
LEAST_RANDOM = 0.001
#: The share of names among the secrets found.
RATE = 0.05


#: Arrays are gone through in blocks of this size, as what grows element by element is copied each time.
BLOCK = 256
NO_SPANS = "array<struct<start:int,place:int,end:int>>"


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """A named array, which is not empty, in blocks."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _running(values: Column, start: Column, step) -> Column:
    """``start`` and what ``step`` makes of it value by value, without the last."""
    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")), lambda seen, x: F.struct(
        step(seen["at"], x).alias("at"), F.array_append(seen["all"], seen["at"]).alias("all")), lambda seen: seen["all"])


def _spans(text: Column, pattern: str, least: int, kind: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters, as structs (start, place of kind, end)."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    # What lies between the matches gives their positions.
    steps = F.zip_with(F.zip_with(whole, F.slice(F.split(text, pattern, -1), 1, F.size(whole)), lambda w, gap: F.struct(
        F.length(gap).alias("gap"), F.length(w).alias("size"))), value, lambda x, v: F.struct(
            x["gap"].alias("gap"), x["size"].alias("size"), F.length(v).alias("value")))
    empty = F.array().cast(NO_SPANS)

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(
            block, F.struct(at.alias("at"), empty.alias("spans")),
            lambda seen, x: F.struct(
                (seen["at"] + x["gap"] + x["size"]).alias("at"),
                F.when(x["value"] >= least, F.array_append(seen["spans"], F.struct(
                    (seen["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("place"), (seen["at"] + x["gap"] + x["size"]).alias("end"))))
                .otherwise(seen["spans"]).alias("spans")),
            lambda seen: seen["spans"])

    def all_placed(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        return F.flatten(F.zip_with(blocks, _running(lengths, F.lit(0), lambda at, x: at + x), placed))

    return _named(steps, lambda found: F.when(F.size(found) > 0, _named(_blocks(found), all_placed)).otherwise(empty))


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns; what a pattern cannot do without is looked for first, as that is cheaper."""
    return F.concat(
        _where(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), _spans(text, ASSIGN, 8, "assign", 2)),
        _where(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 16, "access")),
        _where(text.rlike(HEX[:-1] + "{32}"), _spans(text, HEX, 32, "hex")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic curve (error below 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.07056 * z * z * z)))


def _inferred(token: Column, values: list) -> Column:
    """The value of the encoding that is inferred, null if none is."""
    found = F.lit(None)
    for (pattern, _), value in reversed(list(zip(ENCODINGS, values))):
        found = F.when(token.rlike(pattern), value).otherwise(found)
    return found


def kind_of(letter: str) -> int:
    if letter in "aeiou":
        return VOWEL
    return CONSONANT if letter in LOWER else CAPITAL if letter in UPPER else DIGIT if letter in DIGITS else SEPARATOR


def shares(letters: str) -> list[float]:
    """Of each kind in an alphabet. Capitals count as small letters where there are no others, as do those of a candidate."""
    letters = letters if set(letters) & set(LOWER[6:]) else letters.lower()
    return [sum(kind_of(c) == k for c in letters) / len(letters) for k in range(5)]


def name_p_value(token: Column) -> Column:
    """p-value of the hypothesis that a candidate is a name; null if no encoding is inferred."""
    logs = [F.array(*[F.lit(math.log(x) if x else -9.0) for x in shares(letters)]) for _, letters in ENCODINGS]
    names = F.array(*[F.lit(math.log(x)) for row in IN_NAMES for x in row])
    letters = DIGITS + LOWER + UPPER + "+/-_"
    body = F.rtrim(token, F.lit("="))
    folded = F.when(body.rlike("[a-z]"), body).otherwise(F.lower(body))
    kinds = F.transform(F.split(F.translate(folded, letters, "".join(str(kind_of(c)) for c in letters)), ""), lambda c: c.cast("int"))

    def ratio(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["kinds"], 1, F.size(x["kinds"]) - 1), F.slice(x["kinds"], 2, F.size(x["kinds"]) - 1), lambda a, b: F.get(x["logs"], b) - F.get(names, a * 5 + b))
        return F.exp(-F.greatest(F.lit(0.0), F.least(F.lit(600.0), F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b))))

    return _named(F.struct(kinds.alias("kinds"), _inferred(token, logs).alias("logs")), lambda x: F.when(x["logs"].isNotNull(), ratio(x)))


def p_value(token: Column) -> Column:
    """The battery's p-value of a candidate; null if no encoding is inferred."""
    alphabet = _inferred(token, [F.lit(letters) for _, letters in ENCODINGS])
    # Nested one-element transforms name what is used more than once, so it is worked out once.
    coded = F.transform(F.array(F.struct(F.rtrim(token, F.lit("=")).alias("body"), alphabet.alias("letters"))), lambda x: F.struct(
        F.transform(F.split(x["body"], ""), lambda c: F.instr(x["letters"], c).cast("double") - 1).alias("x"),
        F.length(x["letters"]).cast("double").alias("k")))

    def sums(c: Column) -> Column:
        x, k = c["x"], c["k"]
        n = F.size(x).cast("double")
        following = F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
        leading = F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
        total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        squares = F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b)
        products = F.aggregate(F.zip_with(leading, following, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        # In order, the j-th of equal symbols adds j * j - (j - 1) * (j - 1) to the sum of squared counts.
        counts = F.aggregate(
            F.array_sort(x), F.struct(F.lit(-1.0).alias("symbol"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
            lambda a, s: _named(F.when(s == a["symbol"], a["run"]).otherwise(0.0) + 1, lambda run: F.struct(
                s.alias("symbol"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))), lambda a: a["sum"])
        high = F.size(F.filter(x, lambda s: s >= k / 2)).cast("double")
        runs = 1 + F.size(F.filter(F.zip_with(leading, following, lambda a, b: (a >= k / 2) != (b >= k / 2)), lambda s: s)).cast("double")
        return F.struct(n.alias("n"), k.alias("k"), total.alias("total"), squares.alias("squares"), products.alias("products"),
                        counts.alias("counts"), high.alias("high"), runs.alias("runs"))

    def tests(s: Column) -> Column:
        n, k = s["n"], s["k"]
        df = k - 1
        chi = s["counts"] * k / n - n
        even = _tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        low = n - s["high"]
        expected = 2 * s["high"] * low / n + 1
        variance = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
        runs = F.when((s["high"] == 0) | (low == 0), F.lit(0.0)).otherwise(2 * _tail(F.abs(s["runs"] - expected) / F.sqrt(variance)))
        mean = s["total"] / n
        spread = F.greatest(s["squares"] - n * mean * mean, F.lit(1e-9))
        correlation = (s["products"] - (n - 1) * mean * mean) / spread
        serial = 2 * _tail(F.abs(correlation + 1 / n) * F.sqrt(n))
        return F.least(F.lit(1.0), 3 * F.least(even, runs, serial))

    found = F.transform(F.transform(coded, sums), tests)[0]
    return F.when(alphabet.isNotNull(), found)


def candidates(docs: DataFrame, text: str, found: str) -> DataFrame:
    """``docs`` with ``found``: for each token of the column ``text`` that has any, the token's ``body`` and ``start``, and its candidates (start, place, end, p, name).

    A token that as a whole looks random is its only candidate. A name cannot be refuted at more than the rate, so the battery is asked below that only. Column by
    column, as each level of functions within functions costs the analyzer a round.
    """
    is_run = lambda token: token.rlike("|".join(f"^{run}$" for run in RUNS))
    battery = lambda name, body: F.when(name <= RATE, p_value(body)).otherwise(0.0).alias("p")
    part = lambda t, s: F.substring(t["body"], s["start"] - t["start"] + 1, s["end"] - s["start"])
    place = F.lit(KINDS.index("random")).alias("place")
    keep = lambda t, *more: F.struct(t["body"].alias("body"), t["start"].alias("start"), *more)
    tokens = F.zip_with(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _spans(F.col(text), TOKEN, 24, "random"),
                        lambda token, span: F.struct(token.alias("body"), span["start"].alias("start"), F.when(is_run(token), name_p_value(token)).alias("name")))
    step = docs.withColumn(found, F.when(F.col(text).rlike(TOKEN), tokens))
    step = step.withColumn(found, F.transform(found, lambda t: keep(t, F.struct(
        t["start"].alias("start"), place, (t["start"] + F.length(t["body"])).alias("end"), battery(t["name"], t["body"]), t["name"].alias("name")).alias("whole"))))
    certain = lambda t: F.coalesce((t["whole"]["name"] <= RATE) & (t["whole"]["p"] >= LEAST_RANDOM), F.lit(False))
    runs = lambda t: F.when(~certain(t), F.array_distinct(F.concat(*[_spans(t["body"], run, 24, "random") for run in RUNS]))).otherwise(F.array().cast(NO_SPANS))
    moved = lambda t: F.transform(runs(t), lambda s: F.struct((t["start"] + s["start"]).alias("start"), place, (t["start"] + s["end"]).alias("end")))
    step = step.withColumn(found, F.transform(found, lambda t: keep(t, t["whole"].alias("whole"), moved(t).alias("runs"))))
    named = lambda t: F.transform(t["runs"], lambda s: F.struct(s["start"].alias("start"), place, s["end"].alias("end"), _named(part(t, s), name_p_value).alias("name")))
    step = step.withColumn(found, F.transform(found, lambda t: keep(t, t["whole"].alias("whole"), F.filter(named(t), lambda s: s["name"].isNotNull()).alias("runs"))))
    tested = lambda t: F.transform(t["runs"], lambda s: F.struct(
        s["start"].alias("start"), place, s["end"].alias("end"), _named(part(t, s), lambda body: battery(s["name"], body)).alias("p"), s["name"].alias("name")))
    step = step.withColumn(found, F.transform(found, lambda t: keep(t, F.when(certain(t), F.array(t["whole"])).otherwise(tested(t)).alias("runs"))))
    return step.withColumn(found, F.filter(found, lambda t: F.size(t["runs"]) > 0))


def _length_class(size: Column) -> Column:
    found = F.lit(0)
    for i, low in enumerate(LENGTHS):
        found = F.when(size >= low, F.lit(i)).otherwise(found)
    return found


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> list[float]:
    """By length class, ``rate`` being ``RATE`` at most: the largest p-value that refutes a name, 0 if none does.

    Every candidate of the corpus is counted, one that the battery rejects as a name; what comes back is one number per length class and step.
    """
    found = candidates(docs.select(docs[text].alias("text")), "text", "found")
    each = found.select(F.explode("found").alias("t")).select(F.explode("t.runs").alias("c")).select(
        _length_class(F.col("c.end") - F.col("c.start")).alias("class"),
        F.least(F.lit(STEPS), F.floor(-10 * F.log10(F.greatest(F.when(F.col("c.p") < LEAST_RANDOM, 1.0).otherwise(F.col("c.name")), F.lit(1e-30))))).cast("int").alias("step"))
    counts: dict[int, dict[int, int]] = {}
    for row in each.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(row["class"], {})[row["step"]] = row["n"]
    found = []
    for i in range(len(LENGTHS)):
        steps = counts.get(i, {})
        total, seen, limit = sum(steps.values()), 0, 0.0
        for step in sorted(steps, reverse=True):  # from the smallest p-values up
            seen += steps[step]
            upper = math.pow(10, -step / 10)
            if upper <= rate * seen / total:
                limit = upper
        found.append(limit)
    return found


def scan(docs: DataFrame, text: str = "text", rate: float = RATE, spans: str = "spans") -> DataFrame:
    """``docs`` with ``spans``, in place of a column of this name: array of (start, place, end), sorted, ``place`` an index into ``KINDS``."""
    body = F.coalesce(docs[text], F.lit(""))
    limits = F.array(*[F.lit(x) for x in thresholds(docs, text, rate)])
    docs = docs.drop(spans)
    around = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])
    size = lambda s: s["end"] - s["start"]
    span = lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"))
    secret = lambda s: (s["p"] >= LEAST_RANDOM) & (s["name"] <= F.get(limits, _length_class(size(s))))

    def of_token(t: Column) -> Column:
        part = lambda a, b: F.split(F.substring(t["body"], a - t["start"] + 1, b - a), BETWEEN)
        beside = lambda s, o: F.concat(part(o["start"], s["start"]), part(s["end"], o["end"]))
        named = lambda s, o: _named(beside(s, o), lambda b: F.forall(b, lambda x: x.rlike(NAME)) & F.exists(b, lambda x: x != ""))
        whole = lambda s: F.aggregate(F.filter(t["runs"], lambda o: around(s, o) & ~named(s, o)), span(s), lambda a, o: F.when(
            size(o) > size(a), span(o)).otherwise(a))
        longest = lambda found: F.filter(found, lambda s: ~F.exists(found, lambda o: around(s, o) & (size(o) > size(s))))
        full = F.filter(t["runs"], lambda s: (size(s) == F.length(t["body"])) & secret(s))
        inside = _named(F.array_distinct(F.transform(F.filter(t["runs"], secret), whole)), longest)
        return _named(full, lambda f: F.when(F.size(f) > 0, F.transform(F.slice(f, 1, 1), span)).otherwise(inside))  # one that is all of its token needs no search

    def apart(base: Column) -> Column:
        """Base spans with those of the method that are not inside one; base spans are looked through by blocks."""
        blocks = F.when(F.size(base) > 0, F.transform(_blocks(base), lambda b: F.struct(
            b.alias("spans"), b[0]["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end")))).otherwise(F.array())
        covered = lambda k, s: F.exists(k, lambda b: around(s, b) & F.exists(b["spans"], lambda o: around(s, o)))
        return _named(blocks, lambda k: F.array_sort(F.concat(base, F.filter(F.coalesce(F.col(random), F.array().cast(NO_SPANS)), lambda s: ~covered(k, s)))))

    b_name, body_name, random = fresh(docs, "base", "body", "random")
    step = docs.select("*", body.alias(body_name)).withColumn(b_name, F.array_sort(base_spans(F.col(body_name))))
    step = candidates(step, body_name, random)
    step = step.withColumn(random, F.flatten(F.transform(random, of_token)))
    return step.select(*[step[c] for c in docs.columns], apart(F.col(b_name)).alias(spans))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, and every group of overlapping spans, replaced by ``mark``.

    Block by block of spans: a block's text is cut out once, as cutting counts characters from the start.
    """
    def of_block(block: Column, at: Column) -> Column:
        end = F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))
        return _named(F.substring(text, at + 1, end - at), lambda here: F.aggregate(
            block, F.struct(at.alias("at"), F.lit("").alias("out")),
            lambda done, s: F.when(s["start"] >= done["at"], F.struct(
                s["end"].alias("at"),
                F.concat(done["out"], F.substring(here, done["at"] - at + 1, s["start"] - done["at"]), F.lit(mark)).alias("out")))
            .otherwise(F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))),
            lambda done: done["out"]))

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda s: s["end"])))
        parts = F.zip_with(blocks, _running(ends, F.lit(0), F.greatest), of_block)
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _named(spans, lambda found: _named(_blocks(found), joined))).otherwise(text)
