r"""Personal data, in DataFrame functions only: fixed kinds by pattern, and terms that disclose them.

Base kinds (email, ip, card, phone) are found in whole texts as leftmost matches without overlap;
matches that fail their check go. Spans are in code points, the end exclusive.

Information-theoretic sanitisation: a found value stands for protected entities, itself and the wider ones it
belongs to: an email's user (the letters of its local part) and domain, an ip's network (two parts), a card's
issuer (six digits), a phone's area (four digits). With df the number of documents that hold something, a word t
(three or more letters) discloses of an entity e, in whose documents it stands, the share
PMI(t; e) / IC(e) = log2(N df(t, e) / (df(t) df(e))) / log2(N / df(e)) of e's information: 1 if t stands with e
only, 0 if they are independent. Small counts are smoothed: with k different texts that hold both, the share counts
k / (k + 1) of itself. Words at or above the threshold are spans of kind ``term`` wherever they stand in e's documents.

sanitised() writes [TERM] for terms; a base value becomes its kind with the wider entity (as in [EMAIL org.net]) if
that discloses less than the threshold of the value's information, IC(wider) / IC(value), and its kind alone if not.

Every count covers all documents. Since a share is at most 1, pairs with too few texts, and entities of one text, are
dropped before any join without loss; words are counted for the pairs' terms only.

Edge cases: null and empty texts give no spans; repeated rows each give a row and count as one text for k;
equal spans are one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import let, written

#: Patterns whose matches equal those of the plain forms; possessive, so that long runs need no recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
THRESHOLD = 0.6
#: Hash buckets of terms that are broadcast (so many rows at most), to count no others.
BUCKETS = 1 << 20
TERM = r"\p{L}{3,}"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of digits: whether the check sum holds."""

    def weight(i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), weight), F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) <= 3) & (F.coalesce(x.cast("int"), F.lit(256)) <= 255)))
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def running(lengths: Column) -> Column:
    """Sum of the lengths before each place, in blocks: the sums of blocks first, then those inside."""

    def of_blocks(step: Column) -> Column:
        def inside(before: Column) -> Column:
            return F.transform(
                lengths,
                lambda x, i: F.get(before, F.floor(i / step).cast("int")) + F.aggregate(F.slice(lengths, (F.floor(i / step) * step).cast("int") + 1, (i % step).cast("int")), F.lit(0), lambda a, b: a + b),
            )

        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * step + 1, step), F.lit(0), lambda a, c: a + c))
        before = let(sums, lambda s: F.transform(s, lambda x, i: F.aggregate(F.slice(s, 1, i), F.lit(0), lambda a, c: a + c)))
        return let(before, inside)

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.pow(F.size(lengths), F.lit(1 / 3)) + 1).cast("int"), of_blocks))


def matches(text: Column, pattern: str) -> Column:
    """Matches of the pattern as an array of (start, end, value): what stands between them gives the places."""

    def placed(found: Column, between: Column) -> Column:
        lengths = F.transform(found, lambda v, i: F.length(F.get(between, i)) + F.length(v))
        return let(lengths, lambda n: let(running(n), lambda before: F.transform(found, lambda v, i: F.struct((F.get(before, i) + F.length(F.get(between, i))).alias("start"), (F.get(before, i) + F.get(n, i)).alias("end"), v.alias("value")))))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda between: placed(found, between))))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and base: an array of (start, rank, end, kind, value) in order."""

    def of(kind: str) -> Column:
        hits = F.filter(matches(F.col("text"), PATTERNS[kind]), lambda m: passes(kind, m["value"]))
        return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast(SPANS)
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9][0-9\x20-]{12}")}
    return own.withColumn("base", F.array_sort(F.concat(*[F.when(needs[k], of(k)).otherwise(none) for k in PATTERNS])))


def wider(kind: Column, value: Column) -> Column:
    """The wider entity that a value of a kind belongs to, as it is written: domain, network, issuer or area."""
    parts = F.split(value, r"\.")
    return (
        F.when(kind == "email", F.lower(F.split_part(value, F.lit("@"), F.lit(2))))
        .when(kind == "ip", F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
        .when(kind == "card", F.substr(digits(value), F.lit(1), F.lit(6)))
        .otherwise(F.substr(digits(value), F.lit(1), F.lit(4)))
    )


def exact(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), digits(value)).otherwise(F.lower(value)))


def in_wider(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("in "), kind, F.lit(":"), wider(kind, value))


def entities(base: Column) -> Column:
    """All entities that the base spans stand for, each once."""

    def of(s: Column) -> Column:
        user = F.regexp_replace(F.lower(F.split_part(s["value"], F.lit("@"), F.lit(1))), "[^a-z]", "")
        user = F.when((s["kind"] == "email") & (F.length(user) >= 3), F.concat(F.lit("user:"), user))
        return F.array(exact(s["kind"], s["value"]), in_wider(s["kind"], s["value"]), user)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(base, of))))


def words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosures(texts: DataFrame, pairs: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """e and t (hashes of entity and term) of every pair at or above the threshold. texts: all n documents' texts;
    pairs: e, t, m (documents of one text that holds both) and n_entity (documents that hold the entity)."""
    both = pairs.groupBy("e", "t").agg(F.sum("m").alias("n_both"), F.count("*").alias("k"), F.first("n_entity").alias("n_entity"))
    smoothed = F.col("k") / (F.col("k") + 1)
    both = written(both.filter(smoothed >= threshold), "pairs")
    spread = some_terms(texts.select(F.explode(words(F.col("text"))).alias("term")), both)
    scored = both.join(spread.groupBy("t").agg(F.count("*").alias("n_term")), "t")
    share = F.log2(F.lit(n) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(n) / F.col("n_entity")) * smoothed
    return scored.filter((F.lit(n) > F.col("n_entity")) & (F.round(share, 9) >= threshold)).select("e", "t")


def some_terms(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """df with t, the hash of term, where its bucket is one of those of wanted's t."""
    bucket = F.pmod(F.col("t"), F.lit(BUCKETS)).cast("int")
    return df.withColumn("t", F.xxhash64("term")).join(F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")  # at most BUCKETS rows


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base (base spans), spans (those and disclosing terms), labels (what sanitised() writes for each span),
    text (null for texts without spans unless with_text) and text_sha256 of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text") if with_text else F.when(F.size("base") > 0, F.col("text"))
    based = written(base_spans(own).select("doc_id", F.xxhash64("text").alias("text_key"), F.sha2("text", 256).alias("text_sha256"), text.alias("text"), "base"), "personal")
    n = based.count()
    found, rest = based.filter(F.size("base") > 0), based.filter(F.size("base") == 0)
    # Copies are one text with a number m: what follows is joined and counted once for each text.
    each = written(found.groupBy("text_key").agg(F.first("text").alias("text"), entities(F.first("base")).alias("entities"), F.count("*").alias("m")), "texts")
    held = each.select("text_key", "m", F.explode("entities").alias("entity"))
    sizes = held.groupBy("entity").agg(F.sum("m").alias("n_entity"), F.count("*").alias("k"))
    known = written(held.join(sizes, "entity"), "entities")
    again = known.filter("k > 1").groupBy("text_key").agg(F.collect_list(F.struct(F.xxhash64("entity").alias("e"), "n_entity")).alias("held"))
    again = written(each.join(again, "text_key").select("text_key", "m", "held", words(F.col("text")).alias("words")), "again")
    pairs = again.select("text_key", "m", "words", F.inline("held")).select("text_key", "m", "e", "n_entity", F.explode("words").alias("term"))
    told = written(disclosures(own, pairs.withColumn("t", F.xxhash64("term")), n, threshold), "told")
    terms = some_terms(pairs.select("text_key", "e", "term"), told).join(told, ["e", "t"], "left_semi").groupBy("text_key").agg(F.collect_set("term").alias("terms"))
    counts = known.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("entity", "n_entity"))).alias("counts"))
    hints = written(counts.join(terms, "text_key", "left"), "hints")
    full = found.join(hints, "text_key")
    extra = F.filter(matches(F.col("text"), TERM), lambda m: F.array_contains("terms", F.lower(m["value"])))
    extra = F.transform(extra, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), m["end"].alias("end"), F.lit("term").alias("kind"), m["value"].alias("value")))
    full = full.withColumn("extra", F.when(F.col("terms").isNull(), F.array().cast(SPANS)).otherwise(extra))
    # A term inside a base span is covered by it already.
    free = F.filter("extra", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    full = full.withColumn("spans", F.array_sort(F.concat("base", free)))
    return full.select("doc_id", "base", "spans", labels(n, threshold).alias("labels"), "text", "text_sha256").unionByName(
        rest.select("doc_id", "base", F.col("base").alias("spans"), F.array().cast("array<string>").alias("labels"), "text", "text_sha256")
    )


def labels(n: int, threshold: float) -> Column:
    """For each of spans its label, by counts (documents of each of the row's entities)."""

    def of(s: Column) -> Column:
        ic = lambda e: F.log2(F.lit(n) / F.try_element_at("counts", e))
        share = F.when(ic(exact(s["kind"], s["value"])) > 0, ic(in_wider(s["kind"], s["value"])) / ic(exact(s["kind"], s["value"])))
        small = (s["kind"] != "term") & (F.round(share, 9) < threshold)
        return F.concat(F.lit("["), F.upper(s["kind"]), F.when(small, F.concat(F.lit(" "), wider(s["kind"], s["value"]))).otherwise(F.lit("")), F.lit("]"))

    return F.transform("spans", of)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sanitised(found: DataFrame) -> DataFrame:
    """found with clean_text: base values and disclosing terms replaced by their labels."""
    ends = F.transform("spans", lambda s, i: F.array_max(F.transform(F.slice("spans", F.lit(1), i + 1), lambda x: x["end"])))

    def joined(ends: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            done = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            return F.when(s["start"] < done, F.lit("")).otherwise(F.concat(F.substr("text", done + 1, s["start"] - done), F.get("labels", i)))

        return F.concat(F.array_join(F.transform("spans", part), ""), F.substr("text", F.coalesce(F.array_max(ends), F.lit(0)) + 1))

    return found.withColumn("clean_text", F.when(F.size("spans") == 0, F.col("text")).otherwise(let(ends, joined)))
