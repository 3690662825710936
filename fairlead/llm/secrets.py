"""Secret scans in DataFrame functions alone: fixed patterns, and character Markov models.

Patterns are found with their places by splitting a text at its matches: gaps and matches alternate,
so running sums of their lengths are the places. Beside them, every long run of token characters, less
what fixed patterns found in it, is scored by two first-order Markov models over characters, one of random
strings and one of ordinary identifiers. It is a secret where the mean log-likelihood ratio of its steps is
high enough; in a run of which that is not true as a whole (a path or a long name with a token in it),
stretches are where the ratio, less the level asked, adds up from a low to a peak.
Both models are trained from labelled samples by counting steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds, in order; (kind, pattern, test for a match m)
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]"
#: Runs that the Markov models judge.
RUN = r"[A-Za-z0-9+/_=-]"
TOKEN_LEAST = 20
#: Mean log-likelihood ratio of a step, in nats, from which a run counts as random.
RATIO = 0.5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats below its peak at which a stretch ends.
DROP = 8.0
SAMPLE_ROWS = 20_000  # texts that training draws identifiers from, about
HELD = 256  # items that `gathered` goes through with a short array
SPANS = "array<struct<start:int,end:int,text:string>>"


def gathered(items: Column, zero: dict[str, Column], step, end) -> Column:
    """end(state) of aggregate(items, zero, step), where the state has an array `out` that steps add to.
    An aggregate copies its state at every step; so steps add to a short array that is put away once for HELD items."""
    names = [k for k in zero if k != "out"]

    def block(state, part):
        first = F.struct(*(state[k].alias(k) for k in names), zero["out"].alias("out"))
        whole = lambda s: F.struct(*(s[k].alias(k) for k in names), F.concat(state["out"], s["out"]).alias("out"))
        return F.transform(F.array(F.aggregate(part, first, step)), whole)[0]

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / HELD).cast("int")), lambda i: F.slice(x, i * HELD + 1, HELD))
    parts = F.flatten(F.transform(F.array(items), cut))  # an array of one binds the items: they are worked out once
    return F.aggregate(parts, F.struct(*(zero[k].alias(k) for k in names), zero["out"].alias("out")), block, end)


def matches(text: Column, pattern: str, least: int = 1) -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches, in code points, end exclusive.
    `least` > 1 leaves out shorter matches after they were found."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("text")))

    def step(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["text"])
        own = F.struct(start.alias("start"), end.alias("end"), pair["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(own)).alias("out"))

    out = gathered(pairs, {"at": F.lit(0), "out": F.array().cast(SPANS)}, step, lambda state: state["out"])
    return F.filter(out, lambda m: F.length(m["text"]) >= least) if least > 1 else out


def blanked(text: Column, pattern: str, test) -> Column:
    """The text with blanks in place of the matches that pass the test, character for character."""
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    part = lambda gap, m: F.concat(gap, F.when(test(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, part), "")


def guarded(text: Column, trigger: str, value: Column) -> Column:
    """The value where the trigger occurs, else an empty array: most texts pay for one search only."""
    return F.when(text.rlike(trigger), value).otherwise(F.array().cast(SPANS))


def labelled_samples(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(sample, random boolean): strings from a hash in base64, upper case with digits and hexadecimal, and
    ordinary identifiers: words joined as in programs, from a place of each of about `rows` texts. Rows and
    places are drawn by a hash of id and text, from all rows and from anywhere in a text."""
    ids = spark.range(3000).select(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256).alias("h"), "id")
    drawn = F.base64(F.unhex("h"))
    pieces = F.array(F.substring(drawn, 1, 40), F.translate(F.upper(F.substring(drawn, 3, 24)), "+/=", "QZ7"), F.substring("h", 1, 40))
    random = ids.select(F.explode(pieces).alias("sample"), F.lit(True).alias("random"))
    texts = docs.select(F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("at")).where("t is not null")
    share = min(1.0, rows / max(1, texts.count()))  # by hash, so that no task orders or gathers what all tasks have
    texts = texts.where(F.pmod("at", F.lit(1 << 30)) < int(share * (1 << 30)))
    words = F.filter(F.split(F.regexp_replace("t", "[^A-Za-z]+", " "), " "), lambda w: F.length(w) > 1)
    words = texts.select(words.alias("w"), "at").where(F.size("w") >= 8)
    words = words.select(F.slice("w", F.pmod(F.shiftright("at", 30), F.size("w") - 7).cast("int") + 1, 8).alias("w"))
    w = lambda i: F.lower(F.col("w")[i])
    forms = F.array(
        F.concat_ws("_", w(0), w(1), w(2), w(3)), F.concat(w(1), F.initcap(w(2)), F.initcap(w(3)), F.initcap(w(4))),
        F.concat_ws("-", w(4), w(5), w(6), w(7)), F.upper(F.concat_ws("_", w(5), w(6), w(7))), F.concat_ws("/", w(2), w(3), w(5), w(7)),
        F.concat(w(0), w(1), w(6), w(7)), F.concat(w(3), F.lit("_v2_2024")), F.concat(w(2), w(3), F.lit("=" * 3)),
    )
    plain = words.select(F.explode(forms).alias("sample"), F.lit(False).alias("random"))
    rules = F.array(*[F.lit(c * 24) for c in "=-_/+"], F.lit("0123456789" * 3), F.lit("abcdefghijklmnopqrstuvwxyz"))
    fixed = spark.range(50).select(F.explode(rules).alias("sample"), F.lit(False).alias("random"))
    same = spark.range(2).select(F.explode(F.array(*[F.lit(c * 24) for c in ALPHABET])).alias("sample"), F.lit(False).alias("random"))
    return random.unionByName(plain).unionByName(fixed).unionByName(same)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all steps from one character of ALPHABET to the next, row by row.
    `samples` has a text and whether it is random; null texts and other characters are passed over.
    Without samples all ratios are 0."""
    n = len(ALPHABET)
    steps = samples.where("sample is not null and random is not null and length(sample) > 1").select("random", "sample", F.explode(F.sequence(F.lit(1), F.length("sample") - 1)).alias("i"))
    steps = steps.select("random", F.expr(f"instr('{ALPHABET}', substr(sample, i, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substr(sample, i + 1, 1))").alias("b"))
    counts = steps.where("a > 0 and b > 0").groupBy("random", "a", "b").count().collect()  # 2 * 67 * 67 rows at most
    table = {True: [[0.5] * n for _ in range(n)], False: [[0.5] * n for _ in range(n)]}
    for r in counts:
        table[r["random"]][r["a"] - 1][r["b"] - 1] += r["count"]
    logs = {k: [[math.log(x / sum(row)) for x in row] for row in t] for k, t in table.items()}
    return [logs[True][a][b] - logs[False][a][b] for a in range(n) for b in range(n)]


def step_ratios(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratios of a run's steps, in order. The run is parted into characters once."""
    n = len(ALPHABET)
    table = F.from_json(F.lit("[" + ",".join(f"{x:.5f}" for x in model) + "]"), "array<double>")  # folded to a constant
    spots = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # an array of one, so that what the steps are made from is a bound value and not worked out for each step
    steps = lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.get(table, a * n + b))
    return F.transform(F.array(spots), steps)[0]


def stretches(ratios: Column, ratio: float = RATIO, least: int = TOKEN_LEAST, drop: float = DROP) -> Column:
    """array<struct<first, last>> of characters (last exclusive) judged random in a run with these steps: the
    whole run, if its mean ratio is high enough. Else, over sums of ratio less the level: a stretch begins where
    the sum is 0 and ends at its peak, once the sum has fallen to 0 or `drop` below the peak; those of `least`
    characters count."""
    span = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    long = lambda s: s["peak_at"] - s["first"] + 1 >= least
    put = lambda s: F.when(long(s), F.concat(s["out"], F.array(span(s["first"], s["peak_at"] + 1)))).otherwise(s["out"])

    def step(s, r):
        at, total, now = s["at"] + 1, s["total"] + r, s["sum"] + r - ratio
        over = (now <= 0) | (now <= s["peak"] - drop)
        keep = lambda new, old: F.when(over, new).when(now > s["peak"], old[0]).otherwise(old[1])
        return F.struct(
            at.alias("at"), total.alias("total"), F.when(over, 0.0).otherwise(now).alias("sum"), keep(F.lit(0.0), (now, s["peak"])).alias("peak"),
            keep(at, (at, s["peak_at"])).alias("peak_at"), F.when(over, at).otherwise(s["first"]).alias("first"), F.when(over, put(s)).otherwise(s["out"]).alias("out"),
        )

    zero = {"at": F.lit(0), "total": F.lit(0.0), "sum": F.lit(0.0), "peak": F.lit(0.0), "peak_at": F.lit(0), "first": F.lit(0), "out": none}
    end = lambda s: F.when((s["at"] > 0) & (s["total"] >= s["at"] * ratio), F.array(span(F.lit(0), s["at"] + 1))).otherwise(put(s))
    return gathered(ratios, zero, step, end)


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end>>: one row for each row of `docs`, spans sorted by
    start, then kind (0 assign, 1 access, 2 hex, 3 markov). The models judge runs of what base spans leave
    of a text. Null texts count as empty; ids may repeat or be null; other columns are ignored; an empty
    table gives no rows. Texts are scanned whole, in time that grows with their length.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 8
    found = base.select(
        "doc_id", "text",
        F.filter(guarded(text, ASSIGN, matches(text, ASSIGN)), lambda m: value(m["text"])).alias("assign"),
        guarded(text, ACCESS, matches(text, ACCESS, 16)).alias("access"),
        # a run of 32 or more is found whole either way; shorter runs are not worth finding
        guarded(text, f"{HEX}{{32}}", matches(text, f"{HEX}{{32,}}")).alias("hex"),
        guarded(text, f"{RUN}{{{TOKEN_LEAST}}}", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text")))).alias("runs"),
    )
    left, at_all = text, {"assign": (ASSIGN, value), "access": (ACCESS, lambda m: F.length(m) >= 16), "hex": (f"{HEX}{{32,}}", lambda m: F.lit(True))}
    for kind, (pattern, test) in at_all.items():
        found = found.withColumn("text", F.when((F.size("runs") > 0) & (F.size(kind) > 0), blanked(left, pattern, test)).otherwise(left))
    run = f"{RUN}{{{TOKEN_LEAST},}}"
    token = F.when(F.size("runs") > 0, matches(left, run)).otherwise(F.array().cast(SPANS))
    judged = F.transform(token, lambda t: F.struct(t["start"].alias("start"), stretches(step_ratios(t["text"], model), ratio).alias("own")))
    placed = lambda t: F.transform(t["own"], lambda x: F.struct((t["start"] + x["first"]).alias("start"), F.lit(3).alias("kind"), (t["start"] + x["last"]).alias("end")))
    as_spans = lambda c, kind: F.transform(c, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    spans = F.array_sort(F.concat(*(as_spans(c, k) for k, c in enumerate(("assign", "access", "hex"))), F.flatten(F.transform(judged, placed))))
    return found.select("doc_id", spans.alias("spans"))


KINDS = ("assign", "access", "hex", "markov")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )
