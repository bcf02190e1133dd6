"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans come from four patterns (email, ip, card, phone); a span is where the
pieces between matches leave off, so positions count code points.  Base spans
are the seeds.  Candidates are other runs of one or several words that have a
kind's shape (digits in groups, addresses spelt with "at" and "dot", odd ip
numbers), outside base spans.  The words beside a span are its lexical patterns:
the two words before it; the word before and the word after.  Words with a digit
or an at sign are one word, "#", in a pattern.

Patterns and the seeds and candidates that stand in them make a bipartite graph,
scored in rounds, for each kind:

* a pattern is as sure as the mean confidence of its distinct instances (one
  doubtful instance added), if ``least_seeds`` of them are seeds;
* a candidate is as sure as its surest pattern; from ``accept`` on it counts as a
  seed in the next round, so that patterns which no base span stands in are
  induced too.

After ``rounds`` rounds, candidates in a pattern of at least ``sure`` are new
spans.  Base spans always stay.

The regular expressions below accept what the contract's do, written so that no
position is tried twice (possessive runs, starts only at a run's first
character or where the last match ended), and places are summed in blocks: a
text's cost follows its length.

Defined cases: a null or empty text has no span; a very long text is read whole
(a pattern's word counts by its first ``WORD`` characters); rows that repeat a
doc_id or text each get their row; a candidate that is equally sure of two kinds
is the first in the order email, ip, card, phone; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, join_on_hot, stage

KINDS = ("email", "ip", "card", "phone")
#: A card pattern asks for 14 digits at once: shorter runs are dropped anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Runs of words that may be personal data: a spelt address, digits in groups, hexadecimal groups, anything with an at sign.
CANDIDATE = (
    r"(?<![\w.%+-])[\w.%+-]++(?: ?[(\[]at[)\]] ?| at )[\w-]++(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[\w-]++)++"
    r"|(?<![\w(+])(?<![0-9][ ().+/-]{1,3})[(+]?(?>[0-9](?:[ ().+/-]{0,3}+[0-9]){6,}+)(?![\w@])"
    r"|(?<![\w:])(?:[0-9A-Fa-f]{1,4}+:{1,2}+){3,}+[0-9A-Fa-f]{0,4}+"
    r"|(?<!\S)(?=\S*@)\S++"
)
WORD = 40
_BLOCK = 256
_ITEM = "struct<s:int,e:int,m:string,w2:string,w1:string,a1:string>"


def _context(before: Column, after: Column, first: Column) -> tuple[Column, Column, Column]:
    """The two words before a span and the one after it, as they count in patterns."""

    def known(w: Column, none: Column) -> Column:
        return F.when(w == "", none).when(w.rlike("[0-9@]"), "#").otherwise(F.left(F.lower(w), F.lit(WORD)))

    back = F.reverse(before)
    edge = F.when(first, "^").otherwise("#")
    w1 = F.reverse(F.regexp_extract(back, r"^\s*+(\S++)", 1))
    w2 = F.reverse(F.regexp_extract(back, r"^\s*+\S++\s++(\S++)", 1))
    return known(w2, edge), known(w1, edge), known(F.regexp_extract(after, r"^\s*+(\S++)", 1), F.lit("$"))


def matches(found: Column, pieces: Column) -> Column:
    """All matches of a pattern with start and end in code points and the words beside them.

    ``found`` are the matches, ``pieces`` what lies before, between and after
    them.  Lengths are summed within blocks and over the blocks' sums.
    """
    n = F.size(found)
    zipped = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), n).alias("b"), F.slice(pieces, F.lit(2), n).alias("a"))

    def item(x: Column, i: Column) -> Column:
        w2, w1, a1 = _context(x["b"], x["a"], i == 0)
        return F.struct(F.length(x["b"]).alias("g"), x["m"].alias("m"), w2.alias("w2"), w1.alias("w1"), a1.alias("a1"))

    def cut(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(_BLOCK)), lambda at: F.slice(items, at + 1, F.lit(_BLOCK)))

    def begins(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda t, x: t + x["g"] + F.length(x["m"])))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, zero, lambda t, x: F.struct((t["at"] + x).alias("at"), F.concat(t["out"], F.array(t["at"])).alias("out")), lambda t: t["out"])

    def place(block: Column, begin: Column) -> Column:
        def add(t: Column, x: Column) -> Column:
            s = t["at"] + x["g"]
            e = s + F.length(x["m"])
            one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["w2"].alias("w2"), x["w1"].alias("w1"), x["a1"].alias("a1")).cast(_ITEM)
            return F.struct(e.alias("at"), F.concat(t["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(f"array<{_ITEM}>").alias("out")), add, lambda t: t["out"])

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is computed once: a lambda's argument, not its body."""
        return F.element_at(F.transform(F.array(value), use), 1)

    placed = bound(F.transform(zipped, item), lambda items: bound(cut(items), lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), place))))
    return F.when(n > 0, placed).otherwise(F.array().cast(f"array<{_ITEM}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        double = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        # A part is at most 255 whatever zeros lead it.
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _shapes(m: Column) -> Column:
    """The kinds that a candidate has the shape of."""
    n = F.length(_digits(m))
    spelt = m.rlike(r"@|[(\[]at[)\]]| at ")
    hexes = m.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$")
    plain = ~spelt & ~hexes
    fits = [spelt, hexes | (plain & m.rlike(r"^[0-9]+(\.[0-9]+){3}$")), plain & n.between(12, 19), plain & n.between(7, 15) & ~m.rlike(r"^[0-9]+(\.[0-9]+)+$")]
    return F.filter(F.array(*[F.when(fit, F.lit(k)) for k, fit in enumerate(fits)]), lambda k: k.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and candidates (arrays of spans with their words), the base spans by start, then kind.

    One pass over the texts, of which nothing else is kept.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digit = F.col("text").rlike("[0-9]")
    at = F.contains("text", F.lit("@"))
    gates = [at, digit & F.contains("text", F.lit(".")), digit, digit & F.contains("text", F.lit("+")), digit | at | F.col("text").rlike(r"[(\[ ]at[)\] ]")]
    none = F.array().cast("array<string>")
    cut = []
    for i, (gate, pattern) in enumerate(zip(gates, [*(PATTERNS[k] for k in KINDS), CANDIDATE], strict=True)):
        cut.append(F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"found{i}"))
        cut.append(F.when(gate, F.split("text", pattern, -1)).otherwise(none).alias(f"pieces{i}"))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", *cut)

    def of(k: int, kind: str) -> Column:
        fine = F.filter(matches(F.col(f"found{k}"), F.col(f"pieces{k}")), lambda x: _valid(kind, x["m"]))
        return F.transform(fine, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["w2"].alias("w2"), x["w1"].alias("w1"), x["a1"].alias("a1")))

    shaped = F.transform(matches(F.col("found4"), F.col("pieces4")), lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "m", "w2", "w1", "a1")], _shapes(x["m"]).alias("kinds")))
    base = F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), F.filter(shaped, lambda x: F.size(x["kinds"]) > 0).alias("candidates"))


def _patterns(x: str) -> Column:
    """The lexical patterns of a span."""
    return F.array(F.concat(F.lit("<"), F.col(f"{x}.w2"), F.lit(" "), F.col(f"{x}.w1")), F.concat(F.col(f"{x}.w1"), F.lit("|"), F.col(f"{x}.a1")))


def _outside(scanned: DataFrame) -> DataFrame:
    """row and span x of candidates that no base span overlaps, by a running end before and a running start after."""
    listed = scanned.filter(F.size("candidates") > 0).select("row", "base", "candidates")
    alone = listed.filter(F.size("base") == 0).select("row", F.explode("candidates").alias("x"))
    both = listed.filter(F.size("base") > 0)
    kind = scanned.schema["candidates"].dataType.elementType.simpleString()
    spans = both.select("row", F.explode("candidates").alias("x")).select("row", F.col("x.s").alias("s"), F.col("x.e").alias("e"), "x")
    spans = spans.unionByName(both.select("row", F.explode("base").alias("b")).select("row", F.col("b.s").alias("s"), F.col("b.e").alias("e"), F.lit(None).cast(kind).alias("x")))
    # Both frames grow from their first row: one that shrinks would be summed anew for each row.
    up, down = (Window.partitionBy("row").orderBy(by).rangeBetween(Window.unboundedPreceding, 0) for by in (F.asc("s"), F.desc("s")))
    is_base = F.col("x").isNull()
    end = F.max(F.when(is_base, F.col("e"))).over(up)
    start = F.min(F.when(is_base, F.col("s"))).over(down)
    free = spans.withColumn("end", end).withColumn("start", start).filter("x IS NOT NULL AND coalesce(end <= s, true) AND coalesce(start >= e, true)")
    return alone.unionByName(free.select("row", "x"))


def bootstrap(seeds: DataFrame, candidates: DataFrame, rounds: int = 3, least_seeds: int = 3, sure: float = 0.6, accept: float = 0.8) -> DataFrame:
    """Patterns that are sure of a kind: pk (pattern and kind), confidence.

    seeds, candidates: pattern-instance pairs (p, k, m), repeats allowed.
    """
    pk, mk = F.struct("p", "k").alias("pk"), F.struct("m", "k").alias("mk")
    told = seeds.select(pk, mk, F.lit(True).alias("seed")).unionByName(candidates.select(pk, mk, F.lit(False).alias("seed")))
    edges = stage(told.groupBy("pk", "mk").agg(F.max("seed").alias("seed")), "pii-edges")
    doubtful = edges.filter("NOT seed").select("pk", "mk")
    degree = stage(doubtful.groupBy("mk").agg(F.count("*").alias("n")), "pii-degree")
    certain = edges.groupBy("pk").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("n"), F.count_if(~F.col("seed")).alias("open"))
    certain = stage(certain, "pii-certain")

    def scored(known: DataFrame) -> DataFrame:
        """known: pk, seeds, mass, n, open."""
        return stage(known.filter(F.col("seeds") >= least_seeds).select("pk", (F.col("mass") / (F.col("n") + 1)).alias("c"), "open"), "pii-patterns")

    patterns = scored(certain.withColumn("mass", F.col("seeds").cast("double")))
    for _ in range(rounds - 1):
        told_by = join_on_hot(doubtful, patterns, "pk", "open")
        tokens = stage(told_by.groupBy("mk").agg(F.max("c").alias("c")).join(degree, "mk"), "pii-tokens")
        gained = join_on_hot(doubtful, tokens, "mk", "n").groupBy("pk").agg(F.sum("c").alias("gain"), F.count_if(F.col("c") >= accept).alias("grown"))
        zero = F.lit(0).cast("double")
        more = certain.join(gained, "pk", "left").select("pk", (F.col("seeds") + F.coalesce("grown", F.lit(0))).alias("seeds"), (F.col("seeds") + F.coalesce("gain", zero)).alias("mass"), "n", "open")
        before, patterns = patterns, scored(more)
        drop(before, tokens)
    drop(edges, degree, certain)
    return patterns.filter(F.col("c") >= sure).select("pk", F.col("c").alias("confidence"))


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, base and extra: arrays of (s, k, e), by start, then kind."""
    scanned = stage(scan(docs), "pii-scan")
    seed = scanned.select(F.explode("base").alias("x")).select(F.explode(_patterns("x")).alias("p"), F.col("x.k").alias("k"), F.lower("x.m").alias("m"))
    free = stage(_outside(scanned), "pii-candidates")
    standing = free.select("row", "x.s", "x.e", F.lower("x.m").alias("m"), F.explode(_patterns("x")).alias("p"), "x.kinds").withColumn("k", F.explode("kinds")).drop("kinds")
    patterns = bootstrap(seed, standing.select("p", "k", "m"), **how)
    many = standing.groupBy(F.struct("p", "k").alias("pk")).agg(F.count("*").alias("n"))
    patterns = stage(patterns.join(many, "pk"), "pii-sure")
    new = join_on_hot(standing.select("row", "s", "e", F.struct("p", "k").alias("pk")), patterns, "pk", "n")
    one = new.groupBy("row", "s", "e").agg(F.max_by("pk.k", F.struct("confidence", -F.col("pk.k"))).alias("k"))
    extra = one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("extra"))
    bare = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return scanned.join(extra, "row", "left").select("doc_id", bare.alias("base"), F.coalesce("extra", none).alias("extra"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans, per document."""

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    spans = span_text(F.array_sort(F.concat("base", "extra")))
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("extra").cast("long").alias("n_extra"))
