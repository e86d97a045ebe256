"""Personal data: fixed patterns with checks, and bootstrapped extraction by context, in DataFrame expressions only.

Seeds are the entities the fixed patterns find. The words before and after them are lexical patterns; a
graph joins patterns to the instances they stand at, both the seeds and other identifier-like words
and runs of digit groups.
Rounds score patterns by how much of what they stand at is known, and instances by their patterns;
what passes the bar in a round counts as known in the next. Accepted instances add spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.session import settle

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5
DOUBT = 2.0
PATTERN_BAR = 0.5
INSTANCE_BAR = 0.8

# The contract's patterns, with possessive loops and with starts only where a run starts or a match has
# just ended. The matches are the same; long runs take linear time and no stack.
_REGEX = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORTH = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{1}[\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# A word with a digit or an at sign, from its first character on.
_IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
# Digit groups, bare or in parentheses, that single blanks, dots, hyphens or the parentheses join; no group goes on as a word.
_GROUP = r"(?:\([0-9]++\)|[0-9]++)(?![^\x20\x09-\x0D\"'()\[\]{}<>,;:!?.-])"
_GROUPS = rf"(?<![^\x20\x09-\x0D\"'(\[{{<,;:!?])\+?+{_GROUP}(?:[\x20.-]?+{_GROUP})++"
_EDGE = "\"'()[]{}<>,;:!?."


def _spaced(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def _matches(docs: DataFrame, regexes: dict[str, str], worth: dict[str, str]) -> DataFrame:
    """A row per match: doc_id, print, kind, i, found, start, end (code points) and the words beside it.

    Splitting at the pattern gives the gaps, extracting it the matches; sums of their lengths over rows
    are the places, so a text of any number of matches takes linear time. Equal rows are found once.
    """
    one = [
        F.when(F.col("text").rlike(worth[kind]), F.struct(F.lit(kind).alias("kind"), F.split("text", r, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(r), F.lit(0)).alias("found")))
        for kind, r in regexes.items()
    ]
    rows = docs.select("doc_id", "print", F.explode(F.array(*one)).alias("m")).where("m is not null and size(m.found) > 0")
    last = lambda gap: F.substring_index(F.rtrim(_spaced(gap)), " ", -1)
    first = lambda gap: F.substring_index(F.ltrim(_spaced(gap)), " ", 1)
    sized = rows.select("doc_id", "print", "m.kind", "m.found", F.transform("m.gaps", lambda g: F.struct(F.length(g).alias("n"), F.right(last(g), F.lit(40)).alias("last"), F.left(first(g), F.lit(40)).alias("first"))).alias("gaps"))
    each = sized.select("doc_id", "print", "kind", F.posexplode(F.transform("found", lambda f, i: F.struct(f.alias("found"), F.get("gaps", i).alias("a"), F.get("gaps", i + 1).alias("b")))).alias("i", "x"))
    each = each.dropDuplicates(["doc_id", "print", "kind", "i"])
    before = Window.partitionBy("doc_id", "print", "kind").orderBy("i")
    end = F.sum(F.col("x.a.n") + F.length("x.found")).over(before).cast("long")
    return each.select("doc_id", "print", "kind", "i", F.col("x.found").alias("found"), (end - F.length("x.found")).alias("start"), end.alias("end"), F.lower("x.a.last").alias("left"), F.lower("x.b.first").alias("right"))


def base_entities(docs: DataFrame) -> DataFrame:
    """The matches of the fixed patterns that pass their checks."""
    found = _matches(docs, _REGEX, _WORTH)
    digits = F.regexp_replace("found", "[^0-9]", "")
    card = F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    ok = F.when(F.col("kind") == "ip", F.col("found").rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")).when(F.col("kind") == "card", card).when(F.col("kind") == "phone", F.length(digits).between(9, 15)).otherwise(True)
    return found.where(ok)


def _patterns(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per lexical pattern that an instance stands in: the word before, after, and both."""
    left = F.when(F.length("left") > 0, F.concat(F.lit("< "), "left"))
    right = F.when(F.length("right") > 0, F.concat(F.lit("> "), "right"))
    return rows.select(*keep, F.explode(F.array_compact(F.array(left, right, F.concat(left, F.lit(" "), right)))).alias("pattern"))


def bootstrap(seeds: DataFrame, others: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind) accepted among ``others`` (instance, left, right) from ``seeds`` (instance, kind, left, right).

    A pattern's score for a kind is the known confidence among its distinct instances over their number
    plus ``DOUBT``; it counts from ``SUPPORT`` known ones and a score of ``PATTERN_BAR``. An instance's is
    one less the product of one less its patterns'; it is known from ``INSTANCE_BAR`` on, under its best kind.
    """
    labelled = _patterns(seeds, "instance", "kind").distinct()
    open_ = settle(_patterns(others, "instance").distinct())
    sizes = settle(labelled.select("pattern", "instance").unionByName(open_).distinct().groupBy("pattern").agg(F.count("*").alias("all")))
    seeded = settle(labelled.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("known")))
    accepted = others.sparkSession.createDataFrame([], "instance string, kind string, score double")
    for _ in range(rounds):
        more = open_.join(accepted, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("known"))
        scored = seeded.unionByName(more).groupBy("pattern", "kind").agg(F.sum("known").alias("known")).join(sizes, "pattern")
        good = scored.where(F.col("known") >= SUPPORT).withColumn("score", F.col("known") / (F.col("all") + DOUBT)).where(F.col("score") >= PATTERN_BAR)
        rated = open_.join(good.select("pattern", "kind", "score"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
        best = Window.partitionBy("instance").orderBy(F.desc("score"), "kind")
        accepted = settle(rated.where(F.col("score") >= INSTANCE_BAR).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"))
    return accepted.select("instance", "kind")


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, ``base`` and ``spans`` of every row: arrays of (start, order, end, kind), code points, end exclusive, ascending.

    ``spans`` holds the base spans and those of accepted instances that overlap none; a word in an accepted run
    of digit groups is part of the run. Null texts are empty, a
    null id is a row like any other, equal rows get equal spans, other columns are ignored, an empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    base = settle(base_entities(source).select("doc_id", "print", "kind", "found", "start", "end", "left", "right"))
    words = _matches(source, {"word": _IDENTIFIER, "run": _GROUPS}, {"word": r"[0-9@]", "run": r"[0-9]\)?[\x20]\(?[0-9]"})
    is_run = F.col("kind") == "run"
    words = words.where(~is_run | F.col("found").contains(" "))  # a run without blanks is a word
    bare = F.when(is_run, F.col("found")).otherwise(F.trim("found", F.lit(_EDGE)))
    lead = F.when(is_run, 0).otherwise(F.length("found") - F.length(F.ltrim("found", F.lit(_EDGE))))
    words = words.select("doc_id", "print", is_run.alias("is_run"), (F.col("start") + lead).alias("start"), bare.alias("instance"), "left", "right").withColumn("end", F.col("start") + F.length("instance")).where(F.length("instance") >= 5)
    a, b = words.alias("a"), base.alias("b")
    taken = (F.col("b.start") < F.col("a.end")) & (F.col("a.start") < F.col("b.end"))
    candidates = settle(a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.print") == F.col("b.print")) & taken, "left_anti"))
    known = bootstrap(base.select(F.col("found").alias("instance"), "kind", "left", "right"), candidates.select("instance", "left", "right"), rounds)
    added = settle(candidates.join(known, "instance").select("doc_id", "print", "kind", "start", "end", "is_run"))
    a, b = added.where("not is_run").alias("a"), added.where("is_run").alias("b")
    parts = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.print") == F.col("b.print")) & taken, "left_anti")
    added = added.where("is_run").unionByName(parts).select("doc_id", "print", "kind", "start", "end", F.lit(False).alias("is_base"))
    every = base.select("doc_id", "print", "kind", "start", "end", F.lit(True).alias("is_base")).unionByName(added)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    packed = every.withColumn("s", F.struct("start", order.alias("order"), "end", "kind"))
    per_doc = packed.groupBy(F.col("doc_id").alias("_i"), F.col("print").alias("_p")).agg(F.sort_array(F.collect_list(F.when(F.col("is_base"), F.col("s")))).alias("base"), F.sort_array(F.collect_list("s")).alias("spans"))
    ids = source.select("doc_id", "print")
    joined = ids.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("print") == F.col("_p")), "left")
    none = F.array().cast(per_doc.schema["spans"].dataType)
    return joined.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
