"""Personal data: base patterns, and bootstrapped contextual extraction, by SQL functions only.

Seed entities (matches of the base patterns) induce lexical patterns: the words beside them. Patterns and the
identifier-like strings that they extract form a graph. In each round a pattern's confidence in a kind is the
share of that kind, and the weight of its support, among what it extracts; a string's confidence combines those
of its confident patterns; confident strings count as entities in the next round. Confident patterns then mark
identifiers that no base pattern knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import durable, joined, table, with_spans

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; distinct entities that a pattern needs; confidence that patterns and strings need.
ROUNDS, SUPPORT, PATTERN_CONFIDENCE, STRING_CONFIDENCE = 3, 5, 0.8, 0.8
#: Code points beside an identifier in which its context words are sought.
CONTEXT = 48

# The base patterns. Possessive forms and the conditions on the start find the same matches as the
# plain forms, in linear time and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like strings: words with a digit or an at sign (they may begin with a digit), and runs of digits with
#: separators, up to where such a word begins.
IDENTIFIER = r"(?<![A-Za-z0-9._%+@-])(?:(?=[0-9.+-]*+[A-Za-z_%@])[0-9][A-Za-z0-9._%+@-]*+|\+?[0-9](?:[.-]*+[0-9]|[.-]*+[\x20()][\x20().-]*+(?![0-9.+-]*+[A-Za-z_%@])[0-9])*+[A-Za-z_%@+]?+|(?=[A-Za-z._%-]*+[0-9@])[A-Za-z][A-Za-z0-9._%+@-]*+)"


def _may_match(kind: str, text: str) -> Column:
    """What every text with a match of a base pattern, or with an identifier-like string (near), has in it; most have not."""
    t = F.col(text)
    mark = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]"), "phone": F.contains(t, F.lit("+"))}
    return mark[kind] if kind in mark else mark["email"] | mark["card"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.try_cast(turned.substr(i + 1, F.lit(1)), "int") if hasattr(F, "try_cast") else turned.substr(i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str):
    def check(x: Column) -> Column:
        m = x["m"]
        if kind == "ip":
            # a part is a number of up to 255, whatever zeros lead it
            return F.forall(F.split(m, "[.]"), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
        if kind == "card":
            return F.when(F.length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False)
        if kind == "phone":
            return F.length(_digits(m)).between(8, 15)
        return F.lit(True)

    return check


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Columns email, ip, card and phone: the valid matches of each base pattern in the whole text."""
    for kind in KINDS:
        docs = with_spans(docs, text, kind, PATTERNS[kind], None if kind == "email" else _valid(kind), where=_may_match(kind, text))
    return docs


def _words(piece: Column, last: bool) -> Column:
    """The word directly beside an identifier, lower-cased, without its punctuation; null where there is none."""
    shape = r"([\p{L}\p{M}]+)[^\p{L}\p{M}]*$" if last else r"^[^\p{L}\p{M}]*([\p{L}\p{M}]+)"
    word = F.regexp_extract(F.lower(piece), shape, 1)
    return F.when(word != "", word)


def _seed(m: Column) -> Column:
    """The kind that the base patterns see in an identifier-like string, or null."""
    kind = F.when(m.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    kind = kind.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.when(_valid("ip")(F.struct(m.alias("m"))), "ip"))
    kind = kind.when(m.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$"), F.when(F.length(_digits(m)).between(8, 15), "phone"))
    return kind.when(m.rlike(r"^[0-9](?:[\x20-]?[0-9])++$"), F.when(_valid("card")(F.struct(m.alias("m"))), "card"))


def scan(docs: DataFrame, text: str) -> DataFrame:
    """One pass over the texts: base matches and identifier-like strings with the words beside them, without texts."""

    def kept(x: Column) -> Column:
        # digits after a plus sign, or before one, that go on in another way
        return ~x["m"].rlike(r"^\+.*[A-Za-z_%@+]$|^[^A-Za-z_%@]*\+$")

    out = base_spans(docs, text)
    out = with_spans(out, text, "near", IDENTIFIER, kept, context=CONTEXT, where=_may_match("near", text))
    slim = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    out = out.withColumns({k: F.transform(k, slim) for k in KINDS})
    # a full stop or hyphen at the end of a word belongs to the sentence
    cut = lambda x: F.regexp_replace(x["m"], r"[.%+-]+$", "")
    near = F.transform("near", lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(cut(x))).alias("e"), F.lower(cut(x)).alias("m"), x["left"].alias("left"), x["right"].alias("right")))
    return out.withColumn("near", near)


def _occurrences(scanned: DataFrame) -> DataFrame:
    """A row for each identifier-like string and pattern (word before, word after, both) of each document."""
    one = scanned.select("row", F.explode("near").alias("x")).select("row", "x.s", "x.e", "x.m", _words(F.col("x.left"), True).alias("l"), _words(F.col("x.right"), False).alias("r"))
    patterns = F.array(F.concat(F.lit("l:"), "l"), F.concat(F.lit("r:"), "r"), F.concat(F.lit("b:"), "l", F.lit(" "), "r"))
    return one.select("row", "s", "e", "m", F.explode(F.array_compact(patterns)).alias("pattern"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, pattern_confidence: float = PATTERN_CONFIDENCE, string_confidence: float = STRING_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (pattern, kind, p) and the strings that they discover (m, kind, q).

    ``edges``: distinct (pattern, m, seed). A pattern's confidence is the summed confidence of its entities of a
    kind divided by that of its entities of all kinds, plus one and the binary logarithm of one more than its strings
    without a kind: these don't count as wrong, but the more there are, the more support it takes. It needs
    ``support`` entities of the kind. A string's is one minus the product of its patterns' doubts. Seeds keep confidence 1 in their own kind. Ties go to the first kind by name.
    """
    labels = edges.where("seed IS NOT NULL").select("m", F.col("seed").alias("kind"), F.lit(1.0).alias("q")).distinct()
    reach = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    patterns = found = None
    for _ in range(rounds):
        known = labels if found is None else labels.unionByName(found)
        hit = edges.select("pattern", "m").join(known, "m").groupBy("pattern", "kind").agg(F.sum("q").alias("w"), F.count("*").alias("k"))
        whole = hit.groupBy("pattern").agg(F.sum("w").alias("all"), F.sum("k").alias("labelled")).join(reach, "pattern")
        doubt = 1 + F.log2(1 + F.greatest(F.col("n") - F.col("labelled"), F.lit(0)))
        patterns = hit.join(whole, "pattern").select("pattern", "kind", (F.col("w") / (F.col("all") + doubt)).alias("p"), "k").where((F.col("k") >= support) & (F.col("p") >= pattern_confidence))
        patterns = durable(patterns.select("pattern", "kind", "p"))
        strings = edges.where("seed IS NULL").select("pattern", "m").join(patterns, "pattern")
        scored = strings.groupBy("m", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("q"))
        best = scored.groupBy("m").agg(F.max_by(F.struct("kind", "q"), F.struct("q", F.expr("-ascii(kind)"))).alias("b"))
        found = durable(best.select("m", "b.kind", "b.q").where(F.col("q") >= string_confidence))
    return patterns, found


def extract(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rounds: int = ROUNDS) -> DataFrame:
    """Kept columns with ``base`` and ``spans``: arrays of (kind, s, e) in the order of kind, then start.

    ``spans`` has the base matches and, after them in the same order, what the method adds; additions that overlap a
    base match go; those that overlap each other stay. Null and empty texts have none. Repeated rows have equal results, a
    row each; an empty table gives an empty result; a kept column that is called like a result (base, spans) gives way to
    it, others may have any name. Texts are read once, whole; only strings and their contexts are shuffled.
    """
    keep = tuple(c for c in keep if c not in ("base", "spans"))
    own = [f"__keep{i}" for i in range(len(keep))]  # kept columns travel under names of their own
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)], F.col(f"`{text}`").cast("string").alias("__text"))
    scanned = durable(scan(scanned, "__text").select("row", *own, *KINDS, "near"))
    occurrences = _occurrences(scanned)
    edges = durable(occurrences.select("pattern", "m").distinct().withColumn("seed", _seed(F.col("m"))))
    patterns, found = bootstrap(edges, rounds)
    added = occurrences.join(patterns, "pattern").join(found.drop("q"), ["m", "kind"]).select("row", "kind", "s", "e").distinct()
    added = _clear_of_base(durable(added), scanned)
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("__added"))

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    def more(kind: str) -> Column:
        return F.filter(F.col("__added"), lambda x: x["kind"] == kind)

    out = scanned.drop("near").join(added, "row", "left").withColumn("base", F.concat(*[of(k) for k in KINDS]))
    none = F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>")
    every = [F.array_sort(F.concat(of(k), F.when(F.col("__added").isNotNull(), more(k)).otherwise(none)), _by_start) for k in KINDS]
    return out.withColumn("spans", F.concat(*every)).select(*[F.col(o).alias(c) for c, o in zip(keep, own)], "base", "spans")


def _clear_of_base(added: DataFrame, scanned: DataFrame) -> DataFrame:
    """The additions (row, kind, s, e) that overlap no base match of their document.

    A window over a document's base matches and additions in order of their start: the greatest end before, and the next
    start after, tell. Only documents with additions take part.
    """
    spans = F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS])
    base = scanned.join(added.select("row").distinct(), "row", "left_semi").select("row", F.explode(spans).alias("x"))
    both = added.withColumn("own", F.lit(1)).unionByName(base.select("row", F.lit(None).cast("string").alias("kind"), "x.s", "x.e", F.lit(0).alias("own")))
    order = Window.partitionBy("row").orderBy("s", "own")
    reach = F.max(F.when(F.col("own") == 0, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("own") == 0, F.col("s"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumns({"reach": F.coalesce(reach, F.lit(0)), "after": F.coalesce(after, F.lit(1 << 60))})
    return seen.where("own = 1 AND reach <= s AND after >= e").select("row", "kind", "s", "e")


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["e"] < b["e"], -1).when(a["e"] > b["e"], 1).otherwise(0)


#: Code points of a block of text, and spans of a block of spans, when texts are rebuilt.
TEXT_BLOCK, SPAN_BLOCK = 1024, 256


def redact(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """``docs`` with each span of the text (kind, s, e) replaced by its kind in square brackets; overlapping spans become
    one, of the kind that begins first (then: ends first). Null spans and null texts change nothing.

    In time proportional to the text and the spans: ends are carried over blocks of spans, and what lies between two spans is
    cut from blocks of text.
    """
    blocks, ordered, ends, reach = (F.col(f"__redact_{x}") for x in ("blocks", "spans", "ends", "reach"))
    n = F.size(ordered)

    def running(x: Column, start: Column) -> Column:
        """The greatest value before each."""
        state = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, state, lambda a, v: F.struct(F.greatest(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def piece(a: Column, b: Column) -> Column:
        """The text from one code point up to another."""
        i, j = F.floor(a / TEXT_BLOCK).cast("int"), F.floor((b - 1) / TEXT_BLOCK).cast("int")
        from_a = (a - i * TEXT_BLOCK + 1).cast("int")
        many = F.concat(F.get(blocks, i).substr(from_a, F.lit(TEXT_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.get(blocks, j).substr(F.lit(1), (b - j * TEXT_BLOCK).cast("int")))
        return F.when(b <= a, "").when(i == j, F.get(blocks, i).substr(from_a, (b - a).cast("int"))).otherwise(many)

    some = F.size(F.col(spans)) > 0
    docs = docs.withColumn("__redact_spans", F.when(some, F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))))
    docs = docs.withColumn("__redact_blocks", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))))
    docs = docs.withColumn("__redact_ends", F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SPAN_BLOCK).cast("int")), lambda b: F.transform(F.slice(ordered, b * SPAN_BLOCK + 1, SPAN_BLOCK), lambda x: x["e"])))
    docs = docs.withColumn("__redact_reach", running(F.transform(ends, F.array_max), F.lit(0).cast("bigint")))
    docs = docs.withColumn("__redact_reach", F.flatten(F.zip_with(ends, reach, running)))
    # spans that begin where another hasn't ended go; the rest follow the reach of all before them
    pairs = F.zip_with(ordered, reach, lambda x, r: F.struct(r.alias("r"), x["s"].alias("s"), x["kind"].alias("kind")))
    parts = F.transform(F.filter(pairs, lambda x: x["s"] >= x["r"]), lambda x: F.concat(piece(x["r"], x["s"]), F.lit("["), x["kind"], F.lit("]")))
    last = F.array_max(F.transform(ordered, lambda x: x["e"]))
    whole = F.concat(F.array_join(parts, ""), piece(last, F.length(text).cast("bigint")))
    docs = docs.withColumn(text, F.when(F.col("__redact_spans").isNotNull() & F.col(text).isNotNull(), whole).otherwise(F.col(text)))
    return docs.drop(*[f"__redact_{x}" for x in ("spans", "blocks", "ends", "reach")])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = extract(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )
