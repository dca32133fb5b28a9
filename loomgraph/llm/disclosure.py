"""Personal data, and the terms that give it away.

Base entities are found by pattern: e-mail and IP addresses, card and phone
numbers.  How strongly a term reveals an entity is estimated from the whole
corpus by pointwise mutual information over documents,

    PMI(e; t) = log2(N n(e, t) / (n(e) n(t))),   IC(e) = log2(N / n(e)),

with n the number of documents that hold the entity, the term, or both, however
far apart.  Text inside entities holds no terms.  PMI / IC is 1 when every
document with the term names the entity.  A term discloses by its strongest
entity: it is removed from ``REMOVE`` on and generalised to its kind from
``GENERALISE`` on, in ``sanitised`` in every text that holds it.  ``spans`` lists
the places of entities, and of terms in the texts that hold an entity.

Pairs are counted once for all entities that the same documents hold, and only
for terms rare enough to reach ``GENERALISE``: PMI is log2(N / n(t)) at most.

Built-in functions only.  Defined cases: a null text is an empty one and has
nothing; repeated rows are reported each and counted as documents of their own;
an empty table gives no row; other columns are ignored.  Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.core.skew import lookup
from loomgraph.llm.common import fold, keep
from loomgraph.llm.secrets import SALTS
from loomgraph.llm.spans import Rule, located

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_DIGITS = "regexp_replace(g, '[^0-9]', '')"
_LUHN = (
    "aggregate(split(reverse(" + _DIGITS + "), ''), struct(0 as n, 0 as s), "
    "(a, c) -> struct(a.n + 1 as n, a.s + case when c = '' then 0 when a.n % 2 = 0 then int(c) when int(c) < 5 then 2 * int(c) else 2 * int(c) - 9 end as s), "
    "a -> a.s % 10 = 0)"
)
# The contract's patterns.  Runs start where the match before ended or a run begins, and never give back, so long runs cost linear time;
# the leftmost matches are the same.
RULES = (
    Rule("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 0, f"g rlike '^{_PART}([.]{_PART}){{3}}$'"),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", 0, f"char_length({_DIGITS}) between 13 and 19 and {_LUHN}"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"char_length({_DIGITS}) between 9 and 15"),
)
GENERALISE, REMOVE = 0.8, 0.95
#: A term: three letters or digits at least.
TERM = 3
_BREAK = r"[^\p{L}\p{N}]"
_PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
#: Most frequent terms that the driver sees; they are kept out of shuffles.
OFTEN = 2_048


def rows_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): rows get a name from their place, so that repeated ids stay apart."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def entities(rows: DataFrame) -> DataFrame:
    """(row, k, start, end, entity): base spans."""
    spans = located(rows.select("row", "text"), "row", "text", RULES)
    return spans.select("row", "k", "start", "end", fold(F.col("g")).alias("entity"))


def _bind(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _merged(spans: Column) -> Column:
    """Sorted (start, end, k) as disjoint spans; where they overlap, the first one's kind stands for all."""

    def add(a: Column, s: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["k"].alias("k"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint,k:int>>"), add)


def _replaced(chars: Column, spans: Column, put) -> Column:
    """The text of ``chars`` with ``put(s)`` for each of the disjoint sorted spans."""
    part = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), (b - a).cast("int")), "")
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0).cast("bigint"))
    every = F.transform(spans, lambda s, i: F.concat(part(before(i), s["start"]), put(s)))
    return F.concat(F.array_join(every, ""), part(before(F.size(spans)), F.size(chars)))


def _blank(chars: Column, spans: Column) -> Column:
    return _replaced(chars, spans, lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(fold(text), _BREAK + "+", -1)), lambda t: F.char_length(t) >= TERM)


def term_counts(rows: DataFrame, blanked: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term outside entities; ``blanked`` has the texts with entities once as they are and once without."""
    every = rows.select(_words(F.col("text")).alias("words"), F.lit(1).alias("n"))
    every = every.unionByName(blanked.select(_words(F.col("text")).alias("words"), F.lit(-1).alias("n")))
    every = every.unionByName(blanked.select(_words(F.col("blank")).alias("words"), F.lit(1).alias("n")))
    return every.select(F.explode("words").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")


def disclosing(base: DataFrame, blanked: DataFrame, counts: DataFrame, total: int, often: list[str]) -> DataFrame:
    """(term, k) of the terms that disclose an entity: 4 for removed, 5 for generalised."""
    held = base.select("row", "entity").distinct()
    mark = [F.expr(f"bit_xor(xxhash64(row, {n}))").alias(f"h{n}") for n in (1, 2)]
    # entities of the very same documents share all counts, and one of them stands for all
    per = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *mark).where(F.col("n_e") < total)
    stands = per.groupBy("n_e", "h1", "h2").agg(F.min("entity").alias("entity")).select("entity", "n_e")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    stands = stands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = keep(held.withColumn("salt", salt).join(stands, ["entity", "salt"]).select("row", "entity", "n_e"))
    most = held.groupBy("row").agg(F.max("n_e").alias("most"))
    terms = keep(blanked.select("row", F.explode(_words(F.col("blank"))).alias("term")))
    reach = F.log2(total / F.col("n")) >= GENERALISE * F.log2(total / F.col("most")) - 1e-9
    rare = lookup(terms, counts, "term", hot=often).join(most, "row").where(reach).select("row", "term", "n")
    pairs = rare.join(held, "row").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.min("n_e").alias("n_e"), F.min("n").alias("n"))
    ratio = F.log2(total * F.col("n_et") / (F.col("n_e") * F.col("n"))) / F.log2(total / F.col("n_e"))
    rated = pairs.select("term", ratio.alias("ratio")).where(F.col("ratio") >= GENERALISE).groupBy("term").agg(F.max("ratio").alias("ratio"))
    return rated.select("term", F.when(F.col("ratio") >= REMOVE, 4).otherwise(5).alias("k"))


def _kind_of(term: Column) -> Column:
    """What a generalised term becomes."""
    kind = F.when(~term.rlike(r"\p{L}"), "[number]").when(term.rlike(r"\p{N}"), "[code]")
    return kind.when(term.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")


def _applied(text: Column, cuts: Column, terms: Column) -> Column:
    """(hits, sanitised): places of the terms outside entities, and the text without entities and terms."""
    spot = "array<struct<start:bigint,end:bigint,k:int,put:string>>"
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in RULES])

    def hits(blank: Column, known: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            end = a["at"] + F.char_length(p)
            k = F.try_element_at(known, fold(p))
            put = F.when(k == 4, "").otherwise(_kind_of(p))
            hit = F.struct(a["at"].alias("start"), end.alias("end"), k.alias("k"), put.alias("put"))
            return F.struct(end.alias("at"), F.when(k.isNotNull(), F.concat(a["out"], F.array(hit))).otherwise(a["out"]).alias("out"))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spot).alias("out"))
        return F.aggregate(F.regexp_extract_all(blank, F.lit(_PIECE), F.lit(0)), start, step, lambda a: a["out"])

    def both(x: Column) -> Column:
        def done(found: Column) -> Column:
            base = F.transform(x["cuts"], lambda s: F.struct(s["start"], s["end"], s["k"], F.element_at(kinds, s["k"] + 1).alias("put")))
            spots = F.array_sort(F.concat(base.cast(spot), found))
            return F.struct(found.alias("hits"), _bind(spots, lambda v: _replaced(x["chars"], v, lambda s: s["put"])).alias("sanitised"))

        return _bind(hits(_blank(x["chars"], x["cuts"]), x["terms"]), done)

    return _bind(F.struct(F.split(text, "").alias("chars"), _merged(cuts).alias("cuts"), F.map_from_entries(terms).alias("terms")), both)


def report(docs: DataFrame) -> DataFrame:
    """The contract's row for every document: base spans, ``removed`` and ``generalised`` terms after them in ``spans``, and the text without both in ``sanitised``.

    ``docs`` is a stored table, since rows are named by their place in it.
    """
    rows = rows_of(docs)
    base = keep(entities(rows))
    cuts = base.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "k"))).alias("cuts"))
    chars = F.struct(F.split("text", "").alias("chars"), _merged(F.col("cuts")).alias("cuts"))
    blanked = keep(rows.join(cuts, "row").select("row", "text", _bind(chars, lambda x: _blank(x["chars"], x["cuts"])).alias("blank")))
    counts = keep(term_counts(rows, blanked))
    total = rows.count()
    often = [r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(OFTEN).collect()]
    found = keep(disclosing(base, blanked, counts, total, often))
    loud = [r["term"] for r in found.where(F.col("term").isin(often)).collect()]
    quiet = sorted(set(often) - set(loud))
    words = rows.select("row", F.explode(F.filter(_words(F.col("text")), lambda t: ~t.isin(quiet))).alias("term"))
    terms = lookup(words, found, "term", hot=loud).groupBy("row").agg(F.collect_list(F.struct("term", "k")).alias("terms"))
    none, no_terms = F.array().cast("array<struct<start:bigint,end:bigint,k:int>>"), F.array().cast("array<struct<term:string,k:int>>")
    every = rows.join(cuts, "row", "left").join(terms, "row", "left")
    applied = _applied(F.col("text"), F.coalesce("cuts", none), F.coalesce("terms", no_terms))
    every = every.select("doc_id", "text", F.coalesce("cuts", none).alias("cuts"), F.when(F.col("cuts").isNotNull() | F.col("terms").isNotNull(), applied).alias("applied"))
    kinds = F.array(*[F.lit(x) for x in (*[r.kind for r in RULES], "removed", "generalised")])
    spot = lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"))
    listed = F.when(F.size("cuts") > 0, F.array_sort(F.concat(F.transform("cuts", spot), F.transform("applied.hits", spot))))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    said = lambda of: F.coalesce(F.array_join(F.transform(of, one), ","), F.lit(""))
    out = every.select("doc_id", F.coalesce("applied.sanitised", "text").alias("sanitised"), listed.alias("listed"))
    return out.select(
        "doc_id",
        *[F.coalesce(F.size(F.expr(f"filter(listed, s -> s.k = {n})")), F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for n, r in enumerate(RULES)],
        F.sha2(said(F.filter("listed", lambda s: s["k"] < len(RULES))).cast("binary"), 256).alias("base_sha256"),
        said(F.col("listed")).alias("spans"),
        "sanitised",
    )
