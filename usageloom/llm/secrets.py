"""Secret scanning by patterns and a randomness test battery, in DataFrame functions only.

Base kinds are found by pattern: `assign` (a password-like assignment), `access` (AKIA ids) and `hex` (long
runs of lower-case hex digits). The battery adds the kind `random`: runs of LEAST_CHARS or more symbols, not all of them
digits, that overlap no base span. Numbers are left out: invoice, order and card numbers are as random as a key of digits
would be, so there is nothing by which their false discoveries could be held down. The encoding of each is inferred from its symbols (hex, base 32, 36, 62 or 64), which fixes an
alphabet of k symbols, and over the n symbol numbers three tests of randomness are taken:
  - chi-squared of uniform use of the alphabet, with its exact mean k - 1 and variance 2 (k - 1) (1 - 1 / n);
  - the number of runs above and below the alphabet's middle;
  - the lag-1 serial correlation.
A token passes the battery if randomness isn't rejected: the least of the three p-values is GATE / 3 or more. Short tokens
of ordinary text pass now and then, so the rest is a matter of false discoveries: the hypothesis that a token is text is
tested by the same chi-squared, as the normal score z. Under text z grows with the length, as skew * n with a deviation of
spread * sqrt(n); skew and spread are those of each encoding's tokens without a digit, over all documents, of which a random
key is one in some thirty at most (base 62, 20 symbols). Benjamini and Hochberg's rule holds the false-discovery rate at FDR
within each encoding and length stratum, over all of its tokens; those that fail the battery count as p = 1. An encoding with
fewer than LEAST_TEXT tokens without a digit (hex has none of that length) has no text to be mistaken for; there the
battery decides. Equal p-values share a bin, and are accepted or not together. What leaves the executors are counts: by encoding, and by stratum and p-value in bins, rounded up.

Spans are in code points, end exclusive. Defined cases: a null or empty text has no spans; repeated rows have equal
results but count twice in the p-values; texts of any length are scanned whole; an empty table gives an empty result.
Columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.llm.shared import col, stored

#: The patterns of the base kinds and the least length of what they must match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

LEAST_CHARS = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
NUMBER = r"^[0-9]+$"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encoding: pattern, alphabet. The first that fits is inferred.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+$", LOWER + "234567"),
    "base36": (r"^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    "base62": (r"^[0-9A-Za-z]+$", DIGITS + LOWER.upper() + LOWER),
    "base64": (r"", LOWER.upper() + LOWER + DIGITS + "+/"),
}
LENGTHS = [20, 24, 32, 48, 96, 192]
GATE, FDR, LEAST_TEXT = 0.01, 0.05, 50
#: P-values are counted in bins of a twentieth of a power of ten.
BINS, MOST_BIN = 20, 600


def located(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches: a match's bounds, and the text of the group."""
    gaps = F.split(text, pattern, -1)
    hits, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, value_group))
    sized = F.transform(
        hits,
        lambda hit, i: F.struct(
            F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), F.get(values, i).alias("value")
        ),
    )

    def place(done: Column, hit: Column) -> Column:
        start = done.at + hit.gap
        end = start + hit.size
        span = F.struct(start.alias("start"), end.alias("end"), hit.value.alias("value"))
        return F.struct(end.alias("at"), F.concat(done.spans, F.array(span)).alias("spans"))

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)")
    return F.aggregate(sized, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), place, lambda done: done.spans)


def _where(condition: Column, spans: Column) -> Column:
    """The spans, looked for only where the cheap condition allows any."""
    return F.when(condition, spans).otherwise(F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)"))


def base_spans(text: Column) -> dict[str, Column]:
    lowered = F.lower(text)
    named = lowered.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | lowered.contains(word)
    return {
        "assign": F.filter(_where(named, located(text, ASSIGN, 2)), lambda s: F.length(s.value) >= ASSIGN_LEAST),
        "access": _where(text.contains("AKIA"), located(text, ACCESS)),
        "hex": _where(text.rlike(HEX), located(text, HEX)),
    }


def _normal_cdf(z: Column) -> Column:
    """The standard normal distribution function: a logistic curve in the middle (error under 0.0002), a continued fraction in the tails."""
    middle = 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))
    x = F.least(F.abs(z), F.lit(35.0))
    below = x
    for i in (5, 4, 3, 2, 1):
        below = x + i / below
    tail = F.exp(-x * x / 2) / (2.5066282746310002 * below)
    return F.when(x < 2, middle).when(z < 0, tail).otherwise(1 - tail)


def _two_sided(z: Column) -> Column:
    return 2 * _normal_cdf(-F.abs(z))


def encoding_of(token: Column) -> Column:
    found = F.lit("base64")
    for name, (pattern, _) in reversed(list(ENCODINGS.items())[:-1]):
        found = F.when(token.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def battery(token: Column) -> Column:
    """struct<encoding, n, z, p_uniform, p_runs, p_serial> of a token of symbols; z is chi-squared as a normal score."""
    encoding = encoding_of(token)
    plain = F.when(encoding.isin("hex", "base32", "base36"), F.lower(token)).when(encoding == "base64", F.translate(token, "-_", "+/")).otherwise(token)
    alphabets = F.create_map(*[F.lit(x) for name, (_, alphabet) in ENCODINGS.items() for x in (name, alphabet)])
    alphabet = F.element_at(alphabets, encoding)

    def sums(alphabet: Column, k: Column, values: Column) -> Column:
        def walk(a: Column, v: Column) -> Column:
            high = (2 * v >= k).cast("int")
            return F.struct(
                v.alias("last"),
                high.alias("high"),
                (a.n + 1).alias("n"),
                (a.n_high + high).alias("n_high"),
                (a.runs + F.when((a.n == 0) | (a.high != high), 1).otherwise(0)).alias("runs"),
                (a.s + v).alias("s"),
                (a.ss + v * v).alias("ss"),
                (a.sp + F.when(a.n > 0, a["last"] * v).otherwise(0.0)).alias("sp"),
            )

        start = F.struct(
            F.lit(0.0).alias("last"), F.lit(0).alias("high"), F.lit(0).alias("n"), F.lit(0).alias("n_high"), F.lit(0).alias("runs"), *[F.lit(0.0).alias(x) for x in ("s", "ss", "sp")]
        )
        return F.aggregate(values, start, walk)

    def squares(values: Column) -> Column:
        """The sum of the squared counts of each symbol: the m-th of equal values adds 2 m - 1."""
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("m"), F.lit(0.0).alias("total"))

        def walk(a: Column, v: Column) -> Column:
            m = F.when(a["last"] == v, a.m + 1).otherwise(F.lit(1.0))
            return F.struct(v.alias("last"), m.alias("m"), (a.total + 2 * m - 1).alias("total"))

        return F.aggregate(F.array_sort(values), start, walk, lambda a: a.total)

    def tested(x: Column) -> Column:
        n, k, a = x.n.cast("double"), x.k.cast("double"), x.sums
        chi = x.squares * k / n - n
        # A gamma distribution of the statistic's mean and variance, by Wilson and Hilferty's cube root.
        nine = 9 * (k - 1) / (2 * (1 - 1 / n))
        z = (F.cbrt(chi / (k - 1)) - 1 + 1 / nine) * F.sqrt(nine)
        n1, n0 = a.n_high.cast("double"), n - a.n_high
        mean = 1 + 2 * n1 * n0 / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when((n1 == 0) | (n0 == 0) | (variance <= 0), 0.0).otherwise(_two_sided((a.runs - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))))
        spread = n * a.ss - a.s * a.s
        # The ends of the token are joined, which makes the statistic's mean -1/(n-1) and its variance about 1/n.
        r = (n * (a.sp + a["last"] * x.first) - a.s * a.s) / F.greatest(spread, F.lit(1e-9))
        p_serial = F.when(spread <= 0, 0.0).otherwise(_two_sided((r + 1 / (n - 1)) * F.sqrt(n)))
        return F.struct(x.encoding.alias("encoding"), x.n.alias("n"), z.alias("z"), _normal_cdf(-z).alias("p_uniform"), p_runs.alias("p_runs"), p_serial.alias("p_serial"))

    # A one-element array binds what is used often, so that it is computed once.
    numbered = F.transform(F.split(plain, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    bound = F.transform(F.array(F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), numbered.alias("values"))), lambda x: F.struct(
        x.encoding.alias("encoding"),
        F.size(x["values"]).alias("n"),
        F.length(x.alphabet).alias("k"),
        F.get(x["values"], 0).alias("first"),
        sums(x.alphabet, F.length(x.alphabet), x["values"]).alias("sums"),
        squares(x["values"]).alias("squares"),
    ))
    return F.get(F.transform(bound, tested), 0)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, encoding, n, z, words, passed>> of the tokens; words tells that a token has no digit."""
    some = _where(text.rlike(CANDIDATE), located(text, CANDIDATE))
    clear = F.filter(some, lambda s: ~s.value.rlike(NUMBER) & ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end)))
    scored = F.transform(clear, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), (~s.value.rlike("[0-9]")).alias("words"), battery(s.value).alias("t")))
    return F.transform(
        scored,
        lambda s: F.struct(
            s.start.alias("start"), s.end.alias("end"), s.t.encoding.alias("encoding"), s.t.n.alias("n"), s.t.z.alias("z"), s.words.alias("words"),
            (F.least(s.t.p_uniform, s.t.p_runs, s.t.p_serial) >= GATE / 3).alias("passed"),
        ),
    )


def ordinary_text(found: DataFrame) -> dict[str, tuple[float, float]]:
    """(skew, spread) of z in each encoding that has LEAST_TEXT tokens without a digit; at most as many rows as encodings."""
    c = F.col("c")
    sums = found.select(F.explode("candidates").alias("c")).where(c.words).groupBy(c.encoding.alias("encoding")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(c.z).alias("z"), F.sum(c.n).alias("n"), F.sum(c.z * c.z / c.n).alias("zz")
    )
    out = {}
    for r in sums.where(F.col("count") >= LEAST_TEXT).collect():
        skew = r["z"] / r["n"]
        out[r["encoding"]] = (skew, max((r["zz"] - 2 * skew * r["z"] + skew * skew * r["n"]) / r["count"], 1e-6) ** 0.5)
    return out


def stratum(encoding: Column, n: Column) -> Column:
    return F.concat_ws(":", encoding, sum(((n >= x).cast("int") for x in LENGTHS[1:]), F.lit(0)).cast("string"))


def bin_of(c: Column, text: dict[str, tuple[float, float]]) -> Column:
    """The bin of a candidate's p-value of being text: p is 10 ^ (-bin / BINS) at most. Those that fail the battery have p = 1."""
    p = F.lit(0.0)
    for encoding, (skew, spread) in text.items():
        p = F.when(c.encoding == encoding, _normal_cdf((c.z - skew * c.n) / (spread * F.sqrt(c.n.cast("double"))))).otherwise(p)
    small = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_BIN)), F.floor(-BINS * F.log10(F.greatest(p, F.lit(1e-300))))))
    return F.when(c.passed, small).otherwise(0.0).cast("int")


def thresholds(found: DataFrame, text: dict[str, tuple[float, float]]) -> dict[str, int]:
    """For each stratum the least bin that Benjamini and Hochberg's rule accepts; at most 6 encodings times 6 lengths."""
    c = F.col("c")
    binned = found.select(F.explode("candidates").alias("c")).select(stratum(c.encoding, c.n).alias("stratum"), bin_of(c, text).alias("bin"))
    counts = binned.groupBy("stratum", "bin").count()
    whole = Window.partitionBy("stratum")
    ranked = counts.select(
        "stratum", "bin", F.sum("count").over(whole.orderBy(F.desc("bin"))).alias("rank"), F.sum("count").over(whole).alias("total")
    )
    accepted = ranked.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / BINS) <= FDR * F.col("rank") / F.col("total")))
    return {r[0]: r[1] for r in accepted.groupBy("stratum").agg(F.min("bin")).collect()}


def _spanned(order: int):
    return lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("order"), s.end.alias("end"), F.lit(KINDS[order]).alias("kind"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans): array<struct<start, order, end, kind>>, sorted; order is the kind's place in KINDS."""
    text = F.coalesce(col(text_col), F.lit(""))
    by_kind = docs.select(col(id_col).alias("id"), text.alias("text"), *[spans.alias(kind) for kind, spans in base_spans(text).items()])
    base = F.concat(*[F.transform(kind, _spanned(i)) for i, kind in enumerate(KINDS[:3])])
    based = by_kind.select("id", "text", base.alias("base"))
    found = stored(based.select("id", "base", candidates(F.col("text"), F.col("base")).alias("candidates")), "secret-spans")
    text = ordinary_text(found)
    limits = thresholds(found, text)
    if not limits:
        return found.select("id", F.array_sort("base").alias("spans")).withColumnRenamed("id", id_col)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    random = F.filter("candidates", lambda c: bin_of(c, text) >= F.coalesce(F.try_element_at(limit, stratum(c.encoding, c.n)), F.lit(MOST_BIN + 1)))
    spans = F.concat("base", F.transform(random, _spanned(3)))
    return found.select("id", F.array_sort(spans).alias("spans")).withColumnRenamed("id", id_col)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
