"""Secret scan by two character Markov models, in DataFrame functions only.

A first-order Markov model of random strings and one of ordinary identifiers are
trained from labelled samples. The log-likelihood ratio of a run of identifier
characters tells a random string (a key) from a name somebody wrote. Three base
patterns (assignments, access keys, hexadecimal runs) are found as they are; the
models add the runs that overlap no base span and hold a stretch of high ratio, so
that names before or after a key do not hide it. The span is the whole run: the ends
of a stretch may lie inside the key.

Defined results: a null or empty text has no spans; repeated rows give repeated
rows; a null doc_id stays null; an empty table gives an empty table; columns
other than the id and the text are neither read nor returned, so their names
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import dotted, text_id

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")

# The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Characters of the models; a candidate is a run of at least LEAST_RUN of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
LEAST_RUN = 20
#: Mean log-likelihood ratio a transition, in thousandths of a nat, from which a stretch of LEAST_RUN characters or more counts as random.
THRESHOLD = 350

#: Words of which the default samples of ordinary identifiers are put together.
WORDS = (
    "account action address archive array average backup balance batch binary block buffer build button cache call camera category channel "
    "chapter character check client cluster code column command comment common compare config connection constant container content context "
    "control count create current customer database date default delete depth device dictionary digest display document domain driver edge "
    "element encode entry error event example execute export factory feature field file filter final first folder format frame function "
    "gateway group handler hash header height history host identifier image import index input insert install instance integer interface "
    "interval item iterator join kernel language last layer layout length level library limit line link list load local location lock log "
    "manager map master match maximum memory merge message method minimum model module motion name network node number object offset open "
    "operator option order output package page parameter parent parse partition password path pattern payload picture pixel pointer policy "
    "position prefix process profile project property protocol public query queue range reader record region register release remote report "
    "request reset resource response result return sample scale schema score search second section select sensor sequence server service "
    "session shader shape shared signal size sort source split stack start state status step storage stream string structure style suffix "
    "system table target task template text thread time timeline token total track transform tree trigger type union unit update upper user "
    "value variable vector version video view visible width window worker write"
).split()


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """n labelled samples of either kind: (sample string, is_random boolean).

    Random strings are base-64 digests of counters, with either pair of marks,
    base-16 ones, and those in groups of 8, 4, 4, 4 and 12; ordinary strings are two
    to four words in snake case, camel case, one run, capitals, with hyphens, as a
    path, or before a number, and ruled lines of one character.
    """
    words = F.array(*[F.lit(w) for w in WORDS])
    i = F.col("id")

    def word(salt: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(WORDS))) + 1).cast("int"))

    chosen = F.slice(F.array(*[word(s) for s in range(4)]), F.lit(1), (F.pmod(i, F.lit(3)) + 2).cast("int"))
    style = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(8))
    drawn = F.substring(F.lit(ALPHABET), (F.pmod(i, F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))
    name = (
        F.when(style == 0, F.array_join(chosen, "_"))
        .when(style == 1, F.array_join(F.transform(chosen, lambda w: F.initcap(w)), ""))
        .when(style == 2, F.array_join(chosen, ""))
        .when(style == 3, F.upper(F.array_join(chosen, "_")))
        .when(style == 4, F.array_join(chosen, "-"))
        .when(style == 5, F.concat(F.lit("/"), F.array_join(chosen, "/")))
        .when(style == 6, F.repeat(drawn, F.lit(40)))
        .otherwise(F.concat(F.array_join(chosen, "_"), F.lit("_"), F.pmod(i, F.lit(100)).cast("string")))
    )
    digest = F.sha2(F.concat(F.lit("sample "), i.cast("string")), 512)
    base64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    groups = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kind = F.pmod(i, F.lit(6))
    random = F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, groups).when(kind == 2, F.translate(base64, "+/", "-_")).otherwise(base64)
    rows = spark.range(n)
    return rows.select(name.alias("sample"), F.lit(False).alias("is_random")).unionAll(rows.select(random.alias("sample"), F.lit(True).alias("is_random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Log-likelihood ratios of all transitions, in thousandths of a nat, row after row of ALPHABET.

    samples: (sample string, is_random boolean). Null samples and characters
    outside the alphabet are left out. Only the counts of transitions, at most
    two for each pair of the alphabet, reach the driver.
    """
    n = len(ALPHABET)
    chars = F.filter(F.split(F.coalesce("sample", F.lit("")), ""), lambda c: F.lit(ALPHABET).contains(c) & (c != ""))
    pairs = F.when(F.size("c") > 1, F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    counts = samples.where(F.col("is_random").isNotNull()).select("is_random", chars.alias("c")).select("is_random", F.explode(pairs).alias("p")).groupBy("is_random", "p").count()
    seen = {(r["is_random"], r["p"]): r["count"] for r in counts.collect()}
    table = []
    for a in ALPHABET:
        totals = {k: sum(seen.get((k, a + b), 0) for b in ALPHABET) + smoothing * n for k in (True, False)}
        for b in ALPHABET:
            p, q = ((seen.get((k, a + b), 0) + smoothing) / totals[k] for k in (True, False))
            table.append(round(1000 * math.log(p / q)))
    return table


def _codes(string: Column) -> Column:
    """Places of a string's characters in ALPHABET."""
    where = [0] * 128
    for k, c in enumerate(ALPHABET):
        where[ord(c)] = k
    place = F.lit(where)
    return F.transform(F.split(string, ""), lambda c: F.element_at(place, F.ascii(c) + 1))


def best(string: Column, table: Sequence[int], threshold: int = THRESHOLD, least: int = LEAST_RUN) -> Column:
    """The largest sum of ratios less `threshold` a transition over the stretches of `least` characters or more; null where there is none.

    One pass: the sum so far, its last values, and the least of those that lie far enough back.
    """
    weights, n, back = F.lit(list(table)), len(ALPHABET), least - 1
    none = F.lit(None).cast("long")

    def step(acc: Column, code: Column) -> Column:
        now = acc["sum"] + F.when(acc["last"] < 0, F.lit(0)).otherwise(F.element_at(weights, acc["last"] * n + code + 1) - threshold)
        full = F.size(acc["sums"]) == back
        low = F.when(full, F.least(acc["low"], F.element_at(acc["sums"], 1))).otherwise(acc["low"])
        sums = F.concat(F.when(full, F.slice(acc["sums"], 2, back)).otherwise(acc["sums"]), F.array(now))
        return F.struct(code.alias("last"), now.alias("sum"), sums.alias("sums"), low.alias("low"), F.greatest(acc["best"], now - low).alias("best"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums"), none.alias("low"), none.alias("best"))
    return F.aggregate(_codes(string), start, step, lambda acc: acc["best"])


def ratio(string: Column, table: Sequence[int]) -> Column:
    """Sum of the transitions' log-likelihood ratios over a string of the alphabet."""
    weights, n = F.lit(list(table)), len(ALPHABET)
    return F.aggregate(
        _codes(string),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, code: F.struct(code.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0)).otherwise(F.element_at(weights, acc["last"] * n + code + 1))).alias("sum")),
        lambda acc: acc["sum"],
    )


def _lengths(kind: int, with_run: bool):
    """The struct of one match: its order, its length and that of the gap before it."""

    def struct(x: Column, i: Column) -> Column:
        run = x["m"] if with_run else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("value_len"), run.alias("run"))

    return struct


def spans(docs: DataFrame, table: Sequence[int], id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(row, id, kind, start, end, keep) for each span found, and one row of null kind for each document.

    row numbers the input rows, so that repeated rows stay apart. Texts never
    leave the scan: only lengths of matches and of the gaps between them are
    dealt out, and the running sum of both gives the positions.
    """
    text = F.coalesce(dotted(text_column).cast("string"), F.lit(""))
    run = RUN % LEAST_RUN
    if_any = {
        "assign": text.rlike(ASSIGN),
        "access": text.contains("AKIA"),
        "hex": text.rlike("[0-9a-f]{%d}" % LEAST["hex"]),
        "markov": text.rlike("[A-Za-z0-9+/_=-]{%d}" % LEAST_RUN),
    }
    # Runs are as long as they can be, so a least length in these patterns drops the same matches.
    patterns = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4), "hex": r"[0-9a-f]{%d,}" % LEAST["hex"], "markov": run}
    found_type = "array<struct<kind:int,n:int,gap:int,len:int,value_len:int,run:string>>"
    found = []
    for k, kind in enumerate(KINDS):
        matches = F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)) if kind == "assign" else matches
        gaps = F.split(text, patterns[kind], -1)
        rows = F.transform(F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g")), _lengths(k, kind == "markov"))
        found.append(F.when(if_any[kind], rows.cast(found_type)).otherwise(F.array().cast(found_type)))
    none = F.array(F.struct(*[F.lit(None).cast("string" if c == "run" else "int").alias(c) for c in ("kind", "n", "gap", "len", "value_len", "run")])).cast(found_type)
    numbered = docs.select(dotted(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), F.concat(none, *found).alias("found"))
    rows = numbered.select("id", "row", F.explode("found").alias("s")).select("id", "row", "s.*")
    least = F.when(F.col("kind") == 0, F.col("value_len") >= LEAST["assign"]).when(F.col("kind") == 3, best(F.col("run"), table, threshold) >= 0).otherwise(F.lit(True))
    rows = rows.withColumn("good", least).drop("run", "value_len").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.where(F.col("kind").isNull() | F.col("good"))
    is_base = F.col("kind") < 3
    by_start = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_first(), F.col("kind").asc_nulls_first())
    before = F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("before", before).withColumn("after", after)
    clear = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    return rows.where(F.col("kind").isNull() | is_base | clear).select("row", "id", "kind", "start", "end")


def gathered(found: DataFrame) -> DataFrame:
    """One row of (row, id, found array<struct<start,kind,end>>) for each document, spans in order."""
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return found.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(span)).alias("found"))


def scan(docs: DataFrame, table: Sequence[int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, digest and list of the spans of each document."""
    rows = gathered(spans(docs, table, id_column, text_column))
    names = F.lit(list(KINDS))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        F.col("id").alias(id_column),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        count(3).alias("n_markov"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, table: Sequence[int], mark: str = "[SECRET]", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with each span replaced by a mark; overlapping spans become one mark.

    All columns stay, in their order. Spans follow from the text alone, so rows
    meet them by the text's digest, and rows of one text get the same spans.
    """
    rows = docs.select(F.struct(*[dotted(c).alias(c) for c in docs.columns]).alias("doc"), text_id(text_column).alias("tid"))
    named = docs.select(text_id(text_column).alias("tid"), dotted(text_column).alias("text"))
    found = gathered(spans(named, table, "tid", "text")).where(F.size("found") > 0).groupBy(F.col("id").alias("tid")).agg(F.min("found").alias("found"))
    text = F.coalesce(F.col("doc").getField(text_column).cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"].cast("int")).alias("at"), F.concat(acc["out"], gap).alias("out"))

    new = F.aggregate("found", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    out = rows.join(found, "tid", "left").withColumn("new", F.when(F.col("found").isNotNull(), new))
    same = lambda c: F.col("doc").getField(c)
    return out.select(*[F.coalesce("new", same(c)).alias(c) if c == text_column else same(c).alias(c) for c in docs.columns])
