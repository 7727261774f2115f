"""Classification: a scale of levels, markings in texts, document levels and ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import guards

#: The scale from low to high: level, patterns of its banner lines and of its portion marks.
SCALE = [
    ("public", ["UNCLASSIFIED|PUBLIC"], ["U"]),
    ("internal", ["INTERNAL|COMPANY INTERNAL"], ["I"]),
    ("secret", ["(SECRET)(//[A-Z ]+)*"], ["S", "S//NF"]),
    ("top", ["(TOP SECRET)(//[A-Z ]+)*"], ["TS", "TS//NF"]),
]
DEFAULT = "public"


def rank(level: Column) -> Column:
    """Place of a level on the scale; an unknown or null level has the default's."""
    out = F.lit(next(i for i, s in enumerate(SCALE) if s[0] == DEFAULT))
    for i, (name, _, _) in enumerate(SCALE):
        out = F.when(level == name, i).otherwise(out)
    return out


def level_at(place: Column) -> Column:
    """The level at a place; null for null."""
    return F.get(F.array(*[F.lit(s[0]) for s in SCALE]), place)


def markings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add banner and portion: the highest marked on a line of its own, and at the start of a paragraph; null if none."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x, F.lit("*#_-= \t")), r"\s+", " ")))
    lines = F.transform(trimmed, lambda x: F.trim(F.regexp_replace(x, "(?i)^classification:", "")))
    banner = lambda x: F.coalesce(*[F.when(x.rlike(f"^({p})$"), i) for i, (_, ps, _) in reversed(list(enumerate(SCALE))) for p in ps])
    places = F.transform(F.filter(lines, lambda x: (x != "") & (F.length(x) <= 80) & (x == F.upper(x))), banner)
    paragraphs = F.split(text, r"\n\s*\n|\n(?=\s*\()")
    portion = lambda x: F.coalesce(*[F.when(x.rlike(rf"^\s*\(({'|'.join(ps)})\)\s"), i) for i, (_, _, ps) in reversed(list(enumerate(SCALE)))])
    return docs.withColumns({"banner": level_at(F.array_max(places)), "portion": level_at(F.array_max(F.transform(paragraphs, portion)))})


def document_level(manual: Column, banner: Column, portion: Column, cleared: Column) -> Column:
    """A document's level: set by hand, else the higher of its markings, else its collection's clearance, else the default."""
    marked = F.when(banner.isNotNull() | portion.isNotNull(), level_at(F.greatest(F.when(banner.isNotNull(), rank(banner)), F.when(portion.isNotNull(), rank(portion)))))
    return F.coalesce(manual, marked, cleared, F.lit(DEFAULT))


def within(docs: DataFrame, passages: DataFrame, ceiling: str, key: str = "doc_id") -> DataFrame:
    """(key, highest, kept): each document at the highest of its own level and its passages' portion marks, and whether the ceiling admits it.

    ``docs`` (key, level), ``passages`` (key, portion).  An unknown or null level is the default's, an unknown or null portion says nothing.
    """
    known = [s[0] for s in SCALE]
    marks = passages.where(F.col("portion").isin(known)).groupBy(key).agg(F.max(rank(F.col("portion"))).alias("_mark"))
    own = docs.groupBy(key).agg(F.max(rank(F.col("level"))).alias("_own"))
    highest = F.greatest("_own", "_mark")  # nulls are passed over
    return own.join(marks, key, "left").select(key, level_at(highest).alias("highest"), (highest <= rank(F.lit(ceiling))).alias("kept"))


def cleared(operations: DataFrame, ceiling: str | None, remote: bool) -> DataFrame:
    """``operations`` (.., level, local_only, clearance) with held: why an operation isn't offered to a question, null where it is.

    A module above the ceiling is held as a whole (``level``); without a ceiling none is.  Where a model that reads the results is remote,
    operations for local models are held (``local``): those whose clearance says so, or, having none, those of modules that are local only.
    """
    above = F.lit(False) if ceiling is None else rank(F.col("level")) > rank(F.lit(ceiling))
    local = F.when(F.coalesce("clearance", F.lit("")) != "", F.col("clearance") == "local").otherwise(F.coalesce("local_only", F.lit(False)))
    return operations.withColumn("held", F.when(above, "level").when(F.lit(remote) & local, "local"))


def marked_fixture(docs: DataFrame) -> DataFrame:
    """Documents with markings put in by id."""
    turn = F.col("doc_id") % 4
    text = F.when(turn == 0, F.concat(F.lit("SECRET//NOFORN\n"), "text")).when(turn == 1, F.concat(F.lit("Classification: INTERNAL\n"), "text")).when(turn == 2, F.concat(F.lit("(S) "), "text"))
    return docs.select("doc_id", "source", F.coalesce(text, "text").alias("text"))


#: The mark of each level before a paragraph; list items, and what stands as it is.
SHORT = ("U", "I", "S", "TS")
_ITEM = r"^(\s*(?:[-*+]|\d+\.)\s+)(.*)$"
_AS_IS = r"^(#|\||```)"


def marked_output(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Add marked and banner to ``rows`` (text, sources, context): a portion mark before each paragraph and list item, and the highest level.

    ``sources`` maps the numbers of one answer's sources to levels.  A part is at the highest level among the sources it cites; one
    that cites none known is at the context's level (``strict``) or at the default.  Headings, tables and code stay as they are and
    don't count, quotations count without a mark.  A list is a paragraph that begins with an item and whose other lines are items,
    blank or indented.  A null or blank text gives an empty one at the default.
    """
    beyond = F.coalesce(rank(F.col("context")), F.lit(0)) if strict else rank(F.lit(DEFAULT))

    def place(part: Column) -> Column:
        named = F.filter(F.transform(guards.cited(part), lambda n: F.try_element_at("sources", n)), lambda x: x.isNotNull() & (x != ""))
        return F.coalesce(F.array_max(F.transform(named, rank)), beyond)

    mark = lambda at: F.concat(F.lit("("), F.get(F.array(*map(F.lit, SHORT)), at), F.lit(") "))
    out = lambda text, at: F.struct(text.alias("text"), at.cast("int").alias("at"))
    plain = F.lit(None)

    def item(line: Column) -> Column:
        body = F.regexp_extract(line, _ITEM, 2)
        return F.when(line.rlike(_ITEM), out(F.concat(F.regexp_extract(line, _ITEM, 1), mark(place(body)), body), place(body))).otherwise(out(line, plain))

    def paragraph(p: Column) -> Column:
        bare = F.regexp_replace(p, r"^\s+", "")
        lines = F.split(p, r"\r\n|\n|\r")
        listed = F.get(lines, F.lit(0)).rlike(_ITEM) & F.forall(lines, lambda x: x.rlike(_ITEM) | x.rlike(r"^[ \t]|^\s*$"))
        whole = F.array(out(F.when(bare.startswith(">"), bare).otherwise(F.concat(mark(place(p)), bare)), place(p)))
        return F.when(bare.rlike(_AS_IS), F.array(out(p, plain))).when(listed, F.transform(lines, item)).otherwise(whole)

    paragraphs = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    held = rows.withColumn("_parts", F.transform(paragraphs, paragraph))
    text = F.array_join(F.transform("_parts", lambda p: F.array_join(p["text"], "\n")), "\n\n")
    highest = F.array_max(F.flatten(F.transform("_parts", lambda p: p["at"])))
    return held.withColumns({"marked": text, "banner": F.coalesce(level_at(highest), F.lit(DEFAULT))}).drop("_parts")
