"""Index and section texts to entries, by windows over numbered lines.

Texts come as rows (doc_id, text). Lines are dealt in ranges (``line_ranges``), so
that a document of millions of lines is parsed by many tasks; ``size`` is a range's
number of lines and changes no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions.dates import month_number, section_date, us_date
from folioquery.functions.pages import expand_pages
from folioquery.functions.text import found, labelled, strip, tagged, truncate_header
from folioquery.operators.line_ranges import LINES, by_line, by_range, next_lines, ranged


def lines(texts: DataFrame) -> DataFrame:
    """doc_id, n (from 0) and line."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def _entered(rows: DataFrame) -> DataFrame:
    """For each range the entry that is open where it begins, whether its header has begun, and its header lines so far.

    A range is summed up by its last entry, by what follows that entry, and, where no entry
    begins in it, by what it adds to an entry whose header has or has not begun.
    """
    heads, digits = F.col("kind").isin("text", "slash", "glued"), F.col("kind") == "pages"
    ranges = rows.groupBy("doc_id", "range").agg(
        F.max("own").alias("opened"), F.max(F.when(heads, F.col("n"))).alias("head"),
        (F.max("so_far") - F.coalesce(F.max(F.when(F.col("begins"), F.col("so_far"))), F.lit(0))).alias("adds"), F.count_if(heads | digits).alias("adds_late"),
    )
    ranges = ranges.withColumn("begun", F.col("head").isNotNull() & (F.col("opened").isNull() | (F.col("head") > F.col("opened"))))
    ranges = ranges.withColumn("turn", F.count("opened").over(by_range().rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("doc_id", "turn").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("leaves", F.bool_or("begun").over(since)).withColumn("open_begun", F.coalesce(F.lag("leaves").over(by_range()), F.lit(False)))
    added = F.when(F.col("opened").isNull() & F.col("open_begun"), F.col("adds_late")).otherwise(F.col("adds"))
    ranges = ranges.withColumn("left", F.sum(added).over(since))
    return ranges.select("doc_id", "range", F.last("opened", True).over(by_range().rowsBetween(Window.unboundedPreceding, -1)).alias("open"), "open_begun", F.coalesce(F.lag("left").over(by_range()), F.lit(0)).alias("open_lines"))


def vendor_index(texts: DataFrame, last_page: int = fixed.LAST_PAGE, size: int = LINES) -> DataFrame:
    """Entries of an index whose entries begin with a date line that page numbers follow, or with Undated."""
    line = F.col("line")
    is_date = line.rlike(fixed.DATE_LINE)
    kind = (
        F.when(is_date, "text").when(line == "", "blank").when(line.rlike(fixed.SLASH_DIGITS), "slash")
        .when(line.rlike(fixed.PAGES_ONLY), "pages").when(line.rlike(fixed.GLUED_PAGES), "glued").otherwise("text")
    )
    rows = lines(texts).withColumn("line", strip(line)).withColumns({"dated": is_date, "lists": line.rlike(fixed.PAGE_START), "kind": kind})
    rows = ranged(rows, size, ahead=2)
    follows = F.coalesce(F.lead("lists", 1).over(by_line()), F.lit(False)) | F.coalesce(F.lead("lists", 2).over(by_line()), F.lit(False))
    rows = rows.withColumn("begins", (F.col("dated") & follows) | (line == fixed.UNDATED)).filter("not copied")
    rows = rows.withColumn("kind", F.when(F.col("begins"), "start").otherwise(F.col("kind")))
    heads, before = F.col("kind").isin("text", "slash", "glued"), by_line().rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_line().rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(heads, F.col("n")), True).over(before)
    rows = rows.withColumns({"own": F.last(F.when(F.col("begins"), F.col("n")), True).over(so_far), "head": head})
    rows = rows.withColumn("late", F.col("head").isNotNull() & (F.col("own").isNull() | (F.col("head") > F.col("own"))))

    def speaks() -> Column:
        # a line of digits after the header has begun is header text
        return heads | ((F.col("kind") == "pages") & F.col("late"))

    rows = rows.withColumn("so_far", F.sum(speaks().cast("int")).over(so_far))
    rows = rows.drop("dated", "lists", "copied", "head").join(_entered(rows), ["doc_id", "range"])
    rows = rows.withColumns({"late": F.col("late") | (F.col("own").isNull() & F.col("open_begun")), "entry": F.coalesce("own", "open")}).filter("entry is not null")
    rows = rows.withColumn("so_far", F.sum(speaks().cast("int")).over(so_far))
    rows = rows.withColumn("at_start", F.last(F.when(F.col("begins"), F.col("so_far")), True).over(so_far))
    nth = F.col("so_far") - F.when(F.col("own").isNull(), -F.col("open_lines")).otherwise(F.col("at_start"))
    listed = F.when(~F.col("late") & (F.col("kind") == "pages"), line).when(~F.col("late") & (F.col("kind") == "glued"), F.regexp_extract(line, fixed.GLUED_PAGES, 1))
    says = F.when(F.col("kind") == "glued", F.regexp_extract(line, fixed.GLUED_PAGES, 2)).when(speaks(), line)
    rows = rows.withColumns({"listed": listed, "kept": F.when((F.col("kind") == "slash") | (nth <= fixed.HEADER_LINES), says)})

    def joined(column: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("n", F.col(column).alias("t")))))
        return F.array_join(F.transform(parts, lambda p: p["t"]), " ")

    entries = rows.groupBy("doc_id", "entry").agg(F.min_by("line", "n").alias("date_str"), joined("listed").alias("listed"), joined("kept").alias("header"))
    pages = F.filter(expand_pages(F.col("listed")), lambda p: p <= last_page)
    out = entries.select("doc_id", F.col("entry").alias("ordinal"), F.when(F.col("date_str") == fixed.UNDATED, fixed.UNKNOWN).otherwise(us_date(F.col("date_str"))).alias("date"), "date_str", pages.alias("pages"), truncate_header(F.col("header")).alias("header"))
    return out.filter(F.size("pages") > 0)


def _cell(line: Column, pattern: str, group: int = 1) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def own_index(texts: DataFrame, size: int = LINES) -> DataFrame:
    """Entries of a pipe-drawn table whose first column holds dates, in any of six shapes, whole or split over lines."""
    line, size, ahead = F.col("line"), max(size, 4), 4
    rows = ranged(lines(texts).withColumn("c0", _cell(line, fixed.FIRST_CELL)), size, ahead)
    rows = rows.withColumns({f"c{k}": F.lead("c0", k).over(by_line()) for k in range(1, 4)})
    c0, c1, c2, c3 = (F.col(f"c{k}") for k in range(4))

    def make(*parts: Column) -> Column:
        return F.concat_ws("/", *[p.cast("string") for p in parts])

    full = fixed.WRITTEN_CELL
    split_month = month_number(F.concat(c0, c1))
    day, year = _cell(c2, r"^(\d{1,2}),?$"), _cell(c3, r"^(\d{4})$")
    none = F.lit(None).cast("string")
    unknown = c0.rlike("(?i)^unknown$") | (c0 == "Un")
    shapes = (
        (c0.rlike(full), 0, make(month_number(F.regexp_extract(c0, full, 1)), F.regexp_extract(c0, full, 2), F.regexp_extract(c0, full, 3))),
        (c0.rlike("^[A-Za-z]{3,5}$"), 3, F.when(split_month.isNotNull() & day.isNotNull() & year.isNotNull(), make(split_month, day.cast("int"), year))),
        (c0.rlike(r"^\d{4}-$"), 1, F.when(c1.rlike(r"^\d{2}-\d{2}$"), make(F.substring(c1, 1, 2), F.substring(c1, 4, 2), F.substring(c0, 1, 4)))),
        (c0.rlike(r"^\d{1,2}/\d{1,2}$"), 1, F.when(c1.rlike(r"^/\d{2,4}$"), F.concat(c0, c1))),
        (c0.rlike(r"^\d{1,2}/$"), 2, F.when(c1.rlike(r"^\d{1,2}$") & c2.rlike(r"^/\d{2,4}$"), F.concat(c0, c1, c2))),
        (unknown, 0, F.lit("Unknown")),
    )
    first, *rest = shapes
    date_str = reduce(lambda out, s: out.when(s[0], s[2]), rest, F.when(first[0], first[2])).otherwise(none)
    skip = reduce(lambda out, s: out.when(s[0], s[1]), rest, F.when(first[0], first[1])).otherwise(0)
    rows = rows.withColumns({"date_str": date_str, "skip": skip})
    rows = next_lines(rows, size, ahead, rule=line.rlike(fixed.TABLE_RULE), mark=line.rlike(fixed.NEXT_DATE) | F.coalesce(unknown, F.lit(False)))
    ends = F.when(F.col("skip") == 3, F.lead("mark", 4).over(by_line()))
    for k in range(3):
        ends = ends.when(F.col("skip") == k, F.lead("mark", k + 1).over(by_line()))
    rows = rows.withColumn("until", F.least("rule", ends)).filter("not copied")
    final = F.coalesce(F.floor((F.col("until") - 1) / size).cast("int"), F.col("last"))
    anchors = rows.filter("date_str is not null").select("doc_id", F.col("n").alias("ordinal"), "date_str", "until", F.explode(F.sequence("range", F.greatest(final, F.col("range")))).alias("range"))
    said = F.nullif(strip(F.regexp_extract(line, fixed.THIRD_CELL, 1)), F.lit(""))
    parts = rows.select("doc_id", "range", "n", said.alias("said"), F.when(line.rlike(fixed.LAST_CELL), expand_pages(F.regexp_extract(line, fixed.LAST_CELL, 1))).alias("got"))
    parts = parts.filter("said is not null or got is not null")
    inside = (anchors["doc_id"] == parts["doc_id"]) & (anchors["range"] == parts["range"]) & (parts["n"] >= anchors["ordinal"]) & (anchors["until"].isNull() | (parts["n"] < anchors["until"]))
    payload = anchors.join(parts, inside, "left").select(anchors["doc_id"], "ordinal", "date_str", "n", "said", "got")
    entries = payload.groupBy("doc_id", "ordinal", "date_str").agg(F.min_by("said", F.when(F.col("said").isNotNull(), F.col("n"))).alias("header"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("got")))).alias("pages"))
    date = F.when(F.col("date_str") == "Unknown", fixed.UNKNOWN).otherwise(us_date(F.col("date_str")))
    out = entries.select("doc_id", "ordinal", date.alias("date"), "date_str", "pages", truncate_header(F.coalesce("header", F.lit(""))).alias("header"))
    return out.filter((F.col("date_str") != "Unknown") | (F.size("pages") > 0))


def own_sections(texts: DataFrame) -> DataFrame:
    """Marked header lines, split into date and title by the first form that fits."""
    head = strip(F.regexp_extract("line", fixed.SECTION_LINE, 1))
    rows = lines(texts).filter(F.col("line").rlike(fixed.SECTION_LINE)).select("doc_id", (F.col("n") + 1).alias("line_number"), head.alias("full_header"))
    rows = rows.filter(~reduce(lambda a, b: a | b, [F.col("full_header").startswith(s) for s in fixed.SECTION_SKIP]))
    h = F.col("full_header")
    split = [(h.rlike(f), F.struct(strip(F.regexp_extract(h, f, 1)).alias("date_str"), strip(F.regexp_extract(h, f, 2)).alias("title"))) for f in fixed.SECTION_FORMS]
    (c, v), *rest = split
    form = reduce(lambda out, s: out.when(s[0], s[1]), rest, F.when(c, v)).otherwise(F.struct(F.lit(fixed.UNKNOWN_DATE).alias("date_str"), h.alias("title")))
    rows = rows.withColumn("f", form).select("doc_id", "line_number", "f.date_str", "f.title", "full_header")
    return rows.withColumn("normalized_date", section_date(F.col("date_str")))


def vendor_sections(texts: DataFrame, size: int = LINES) -> DataFrame:
    """Headers with their date on the next line, cover letters, and headers with a date in line."""
    header, date, cover, inline = fixed.VENDOR_HEADER, fixed.VENDOR_DATE, fixed.VENDOR_COVER, fixed.VENDOR_INLINE
    rows = ranged(lines(texts).withColumn("line", strip(F.col("line"))), size, ahead=1)
    rows = rows.withColumn("next", F.coalesce(F.lead("line").over(by_line()), F.lit(""))).filter("not copied")
    line, following = F.col("line"), F.col("next")
    two = line.rlike(header) & following.rlike(date)
    form = (
        F.when(two, F.struct(F.regexp_extract(following, date, 1).alias("date_str"), F.concat_ws(", ", *[F.regexp_extract(line, header, g) for g in (1, 2, 3)]).alias("title"), F.concat_ws(" ", line, following).alias("full_header")))
        .when(line.rlike(cover), F.struct(F.regexp_extract(line, cover, 1).alias("date_str"), F.get(F.split(line, ","), 0).alias("title"), line.alias("full_header")))
        .when(line.rlike(inline), F.struct(F.regexp_extract(line, inline, 2).alias("date_str"), F.regexp_extract(line, inline, 1).alias("title"), line.alias("full_header")))
    )
    out = rows.withColumn("f", form).filter("f is not null").select("doc_id", (F.col("n") + 1).alias("line_number"), "f.*")
    return out.withColumn("normalized_date", us_date(F.col("date_str")))


def _prompts(executions: DataFrame, *columns: Column) -> DataFrame:
    rows = executions.filter("status = 'SUCCEEDED'").withColumns({"prompt": F.coalesce("prompt", F.lit("")), "output": F.coalesce("output", F.lit(""))})
    return rows.select(F.col("iteration").alias("index"), *columns)


def _subcategories(prompt: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(prompt, F.lit(fixed.PROMPT_SUBCATEGORY), F.lit(1)), strip)).alias("subcategory")


def pages_in_document(prompt: Column) -> Column:
    """The number of pages that a prompt declares, 1 if it declares none."""
    return F.coalesce(found(prompt, fixed.PROMPT_PAGES).try_cast("int"), F.lit(1))


def legacy_letters(executions: DataFrame, *more: Column) -> DataFrame:
    """Letters for review from the prompts of summary steps: any of three dates, each page line as it stands, the whole output; and ``more`` of prompt and output."""
    prompt = F.col("prompt")
    pages = F.transform(F.regexp_extract_all(prompt, F.lit(fixed.PROMPT_PAGE), F.lit(1)), lambda p: p.try_cast("int"))
    return _prompts(executions, labelled(prompt, *fixed.PROMPT_DATES).alias("date"), labelled(prompt, "Provider").alias("provider"), _subcategories(prompt), pages.alias("pages"), F.col("output").alias("content"), *more)


def legacy_scored_letters(executions: DataFrame) -> DataFrame:
    """Letters for the scorer: Date only, the pages' number (1 if not given), and what the output marks as content, else all of it."""
    prompt, output = F.col("prompt"), F.col("output")
    return _prompts(
        executions, labelled(prompt, "Date").alias("date"), labelled(prompt, "Provider").alias("provider"), F.array().cast("array<string>").alias("category"), _subcategories(prompt),
        pages_in_document(prompt).alias("page_count"), F.coalesce(tagged(output, "content"), output).alias("content"),
    )
