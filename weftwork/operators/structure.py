"""Markdown pages as documents: sections, tables, links, images, formulas, citations, front matter.

Lines are rows; fences, sections, heading stacks and tables are windows over a page's lines; pages are put
together again by one groupBy on the page. Nothing crosses pages, so every step is partitioned by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import markdown as md
from weftwork.functions.text import blank, collapse, strip
from weftwork.operators.chunking import table_lines
from weftwork.operators.taxonomy import area_of_path, domain_of
from weftwork.storage import materialized
from weftwork.vocab import Vocabulary

KEY = "rel_path"
#: Characters of the pages that one task takes apart at a time, about; its lines are sorted several times over.
TASK_CHARS = 1 << 21
NEWS_NAME = r"^(\d{4})-(\d{2})-(\d{2})-(.+)$"


def page_lines(pages: DataFrame) -> DataFrame:
    """``pages(rel_path, body)`` as lines: n from 1, line, whether it is a fence, and whether it stands in one.

    Pages are dealt before they become lines, into as many tasks as their characters ask for; lines are not shuffled.
    """
    chars = pages.agg(F.sum(F.length("body"))).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    lines = pages.repartition(tasks, KEY).select(KEY, F.posexplode(F.split("body", md.LINE_END)).alias("at", "line")).select(KEY, (F.col("at") + 1).alias("n"), "line")
    last = F.max("n").over(Window.partitionBy(KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # in the order that the rest takes too
    lines = lines.withColumn("_last", last).filter("not (n = _last and line = '' and n > 1)").drop("_last")
    fence = strip(F.col("line")).startswith("```")
    so_far = Window.partitionBy(KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("fence", fence).withColumn("fenced", (F.sum(fence.cast("int")).over(so_far) % 2 == 1) | fence)


def link_definitions(lines: DataFrame) -> DataFrame:
    """rel_path, key (lower case), target: definitions outside fences, the last of a key."""
    found = lines.filter(~F.col("fenced")).withColumn("s", strip(F.col("line"))).filter(F.col("s").rlike(md.LINK_DEFINITION))
    key = F.lower(strip(F.regexp_extract("s", md.LINK_DEFINITION, 1)))
    return found.select(KEY, key.alias("key"), "n", md.clean_target(F.regexp_extract("s", md.LINK_DEFINITION, 2)).alias("target")).groupBy(KEY, "key").agg(F.max_by("target", "n").alias("target"))


def footnote_definitions(lines: DataFrame) -> DataFrame:
    """rel_path, citation_id, line, text: definitions outside fences with the indented lines that follow; the last of an id."""
    order = Window.partitionBy(KEY).orderBy("n")
    starts = ~F.col("fenced") & F.col("line").rlike(md.FOOTNOTE_DEFINITION)
    goes_on = F.col("line").rlike("^(?:  |\t)")
    marked = lines.withColumn("starts", starts).withColumn("stops", ~starts & ~goes_on)
    marked = marked.withColumn("start", F.last(F.when(F.col("starts"), F.col("n")), ignorenulls=True).over(order)).withColumn("stop", F.last(F.when(F.col("stops"), F.col("n")), ignorenulls=True).over(order))
    own = marked.filter(F.col("start").isNotNull() & (F.coalesce("stop", F.lit(0)) < F.col("start")))
    text = F.when(F.col("starts"), F.regexp_extract("line", md.FOOTNOTE_DEFINITION, 2)).otherwise(F.col("line"))
    key = F.when(F.col("starts"), strip(F.regexp_extract("line", md.FOOTNOTE_DEFINITION, 1)))
    each = own.groupBy(KEY, "start").agg(F.max(key).alias("citation_id"), F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: strip(x["t"])), lambda t: t != ""), "\n").alias("text"))
    return each.groupBy(KEY, "citation_id").agg(F.max("start").alias("line"), F.max_by("text", "start").alias("raw_text"))


def section_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with section, the number of headings so far; 0 is what stands before the first."""
    heading = F.col("line").rlike(md.HEADING)
    so_far = Window.partitionBy(KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading", heading).withColumn("section", F.sum(heading.cast("int")).over(so_far))


def section_heads(lines: DataFrame) -> DataFrame:
    """One row per section: section_id, parent, level, title, heading_path, start_line, end_line.

    A heading's ancestors are, of each higher level, the last heading before it, if no heading of a higher
    level still came between; repeats of an id get numbers.
    """
    head = lines.filter("heading or section = 0")
    first = head.groupBy(KEY, "section").agg(F.min("n").alias("start_line"), F.min_by("line", "n").alias("line"))
    named = strip(F.regexp_extract("line", md.HEADING, 2))
    custom = strip(F.regexp_extract(named, r"^.*?\s*\{id=([^}]+)\}\s*$", 1))
    real = F.col("section") > 0
    heads = first.select(
        KEY, "section", F.when(real, F.col("start_line")).otherwise(1).alias("start_line"), F.when(real, F.length(F.regexp_extract("line", md.HEADING, 1))).otherwise(0).alias("level"),
        F.when(real, strip(F.regexp_replace(named, r"\s*\{id=[^}]+\}\s*$", ""))).otherwise("Preamble").alias("title"), custom.alias("custom"),
    )
    base = F.when(~real, "__preamble").when(F.col("custom") != "", F.col("custom")).otherwise(md.slugify(F.col("title")))
    heads = heads.withColumn("base", base)
    nth = F.row_number().over(Window.partitionBy(KEY, "base").orderBy("section"))
    heads = heads.withColumn("section_id", F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), nth.cast("string"))))
    before = Window.partitionBy(KEY).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, 7):
        heads = heads.withColumn(f"_a{k}", F.last(F.when(F.col("level") == k, F.struct("section", "section_id", "title")), ignorenulls=True).over(before))
    higher = lambda k: F.greatest(F.lit(0), *[F.coalesce(F.col(f"_a{i}.section"), F.lit(0)) for i in range(1, k)]) if k > 1 else F.lit(0)
    up = F.array_compact(F.array(*[F.when((F.col("level") > k) & (F.col(f"_a{k}.section") > higher(k)), F.col(f"_a{k}")) for k in range(1, 7)]))
    heads = heads.withColumn("up", up)
    end = F.lead("start_line").over(Window.partitionBy(KEY).orderBy("section")) - 1
    last = lines.groupBy(KEY).agg(F.max("n").alias("_last"))
    return heads.withColumn("_end", end).join(last, KEY).select(
        KEY, "section", "section_id", F.try_element_at("up", F.lit(-1))["section_id"].alias("parent_section_id"), "level", "title",
        F.when(real, F.concat(F.transform("up", lambda a: a["title"]), F.array("title"))).otherwise(F.array().cast("array<string>")).alias("heading_path"),
        "start_line", F.greatest("start_line", F.coalesce("_end", "_last")).alias("end_line"),
    )


def content_lines(lines: DataFrame) -> DataFrame:
    """A section's own lines, numbered anew: no headings, definitions or anchor lines; fences counted within the section."""
    so_far = Window.partitionBy(KEY, "section").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lines.filter(~F.col("heading")).withColumn("fenced", (F.sum(F.col("fence").cast("int")).over(so_far) % 2 == 1) | F.col("fence"))
    s = strip(F.col("line"))
    own = own.filter(F.col("fenced") | ~(s.rlike(md.FOOTNOTE_DEFINITION) | s.rlike(md.LINK_DEFINITION)))
    own = own.withColumn("anchor", F.when(F.col("line").rlike(r"^\{id=([^}]+)\}\s*$"), md.anchor(F.regexp_extract("line", r"^\{id=([^}]+)\}", 1))))
    own = own.withColumn("line", F.when(F.col("anchor").isNotNull(), "").otherwise(F.col("line")))
    return own.withColumn("m", F.row_number().over(Window.partitionBy(KEY, "section").orderBy("n")))


def table_marks(own: DataFrame) -> DataFrame:
    """``own`` with table, the number of the table that a line is part of, or null.

    A table is a header line, a separator and rows; it ends before the first line that is no row. A header
    among the rows of a table opens none.
    """
    order = Window.partitionBy(KEY, "section").orderBy("n")  # as content_lines() leaves them, and m goes with n
    free = ~F.col("fenced")
    row = free & md.is_row(F.col("line"))
    flags = own.withColumn("row", row).withColumn("sep", free & md.is_separator(F.col("line")))
    flags = flags.withColumn("opens", free & F.contains("line", F.lit("|")) & F.coalesce(F.lead("sep", 1).over(order), F.lit(False)) & F.coalesce(F.lead("row", 2).over(order), F.lit(False)))
    run = F.sum((~(F.col("row") | F.col("opens"))).cast("int")).over(order)
    flags = flags.withColumn("run", run)
    in_run = Window.partitionBy(KEY, "section", "run").orderBy("n")
    flags = flags.withColumn("start", F.min(F.when(F.col("opens"), F.col("m"))).over(in_run))
    inside = F.col("start").isNotNull() & (F.col("row") | F.col("opens")) & (F.col("m") >= F.col("start"))
    return flags.withColumn("start", F.when(inside, F.col("start"))).withColumn("table", F.when(F.col("start").isNotNull(), F.sum(F.coalesce(F.col("start") == F.col("m"), F.lit(False)).cast("int")).over(Window.partitionBy(KEY, "section").orderBy("run", "n"))))


def section_tables(marked: DataFrame) -> DataFrame:
    """rel_path, section, table and its struct: headers, alignments, rows of one width."""
    cells = F.transform(F.array("line"), md.table_cells)[0]
    each = marked.filter(F.col("start").isNotNull()).groupBy(KEY, "section", "table").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.array_sort(F.collect_list(F.struct("m", cells.alias("cells"), "line"))).alias("ls"))
    width = F.array_max(F.transform("ls", lambda x: F.size(x["cells"])))
    each = each.withColumn("width", width)
    plain = lambda cs: F.transform(cs, md.markdown_to_text)
    headers = F.transform(md.to_width(plain(F.col("ls")[0]["cells"]), F.col("width")), lambda h, i: F.when(blank(h), F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(h))
    rows = F.transform(F.slice("ls", F.lit(3), F.size("ls")), lambda x: md.to_width(plain(x["cells"]), F.col("width")))
    aligned = F.transform(md.to_width(F.col("ls")[1]["cells"], F.col("width")), md.alignment)
    return each.select(
        KEY, "section", "table",
        F.struct(
            F.concat(F.lit("table-"), F.col("table").cast("string")).alias("table_id"), F.col("first").alias("start_line_in_section"), F.col("last").alias("end_line_in_section"), F.col("width").alias("column_count"),
            F.size(rows).alias("row_count"), headers.alias("headers"), aligned.alias("alignments"), rows.alias("rows"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("raw_markdown"),
        ).alias("t"),
    )


def link_context(text: Column, start: Column, end: Column, width: int = 180, limit: int = 320) -> Column:
    """The sentences around a span, as one line of at most 320 characters."""
    left = F.substring(text, F.lit(1), F.greatest(start - width, F.lit(0)))
    head = F.length(F.regexp_extract(left, r"([^.!?\n]*)$", 1))
    right = F.substring(text, F.least(end + width, F.length(text)) + 1, F.length(text))
    tail = F.length(F.regexp_extract(right, r"^([^.!?\n]*)", 1))
    begin = F.greatest(start - width, F.lit(0)) - head
    line = collapse(md.inline_to_text(strip(F.substring(text, begin + 1, F.least(end + width, F.length(text)) + tail - begin))))
    return F.when(F.length(line) > limit, F.concat(F.regexp_replace(F.substring(line, 1, limit - 3), r"\s+$", ""), F.lit("..."))).otherwise(line)


def spans(text: Column, pattern: str, group: int) -> Column:
    """(start, end, whole, group's text) of all matches; offsets are running sums over the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    kind = "array<struct<start:int,end:int,text:string,target:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    add = lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
        F.array_append(s["out"], F.struct((s["at"] + F.length(x["gap"])).alias("start"), (s["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["m"].alias("text"), x["g"].alias("target"))).alias("out"),
    )
    return F.aggregate(parts, start, add, lambda s: s["out"])


def links_in(texts: DataFrame, definitions: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """Edges of ``texts(rel_path, page_id, section, section_id, heading_path, part, text)``.

    Inline links first, then reference links, then bare URLs that overlap no inline link; numbered so within a
    section, its own text before its tables.
    """
    found = texts.withColumn("inline", md.inline_links("text")).withColumn("refs", spans(F.col("text"), md.REFERENCE_LINK, 2)).withColumn("urls", spans(F.col("text"), md.BARE_URL, 0))
    clear = F.filter("urls", lambda u: ~F.exists("inline", lambda i: (u["start"] < i["end"]) & (u["end"] > i["start"])))
    edge = lambda kind, xs, text, target: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), text(x).alias("link_text"), target(x).alias("raw")))
    every = F.concat(
        edge(0, F.col("inline"), lambda x: x["text"], lambda x: md.clean_target(x["target"])),
        edge(1, F.col("refs"), lambda x: F.regexp_extract(x["text"], md.REFERENCE_LINK, 1), lambda x: strip(x["target"])),
        edge(2, clear, lambda x: F.regexp_replace(x["text"], "[.,;:]+$", ""), lambda x: F.regexp_replace(x["text"], "[.,;:]+$", "")),
    )
    rows = found.select(*[c for c in texts.columns], F.explode(every).alias("e")).withColumn("key", F.when(F.col("e.kind") == 1, F.lower("e.raw")))
    rows = rows.join(definitions.select(KEY, "key", F.col("target").alias("_defined")), [KEY, "key"], "left").withColumn("url_raw", F.coalesce("_defined", "e.raw"))
    rows = rows.withColumn("to", md.classify_link(F.col("url_raw"), F.col("page_id"), F.col(KEY), vocab))
    nth = F.row_number().over(Window.partitionBy(KEY, "section", "section_id").orderBy("part", "e.kind", "e.start"))
    return rows.select(
        KEY, "section", nth.alias("nth"), F.concat("section_id", F.lit(":"), nth.cast("string")).alias("edge_id"), F.col("section_id").alias("source_section_id"), F.col("heading_path").alias("source_heading_path"),
        strip(F.col("e.link_text")).alias("link_text"), "url_raw", "to.url_resolved", "to.link_type", "to.target_page_id", "to.target_anchor", (F.col("e.kind") == 1).alias("is_reference_link"),
        F.when(F.col("e.kind") == 1, F.col("e.raw")).alias("reference_key"), link_context(F.col("text"), F.col("e.start"), F.col("e.end")).alias("context"),
    )


def images_in(texts: DataFrame, definitions: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """Images of ``texts``: inline ones, then by reference; those of the site's assets and of other hosts; distinct."""
    inline = F.transform(F.regexp_extract_all("text", F.lit(md.INLINE_IMAGE), F.lit(0)), lambda m: F.struct(F.lit(0).alias("kind"), strip(F.regexp_extract(m, md.INLINE_IMAGE, 1)).alias("alt"), F.regexp_extract(m, md.INLINE_IMAGE, 2).alias("raw"), strip(F.regexp_extract(m, md.INLINE_IMAGE, 3)).alias("title")))
    by_ref = F.transform(F.regexp_extract_all("text", F.lit(md.REFERENCE_IMAGE), F.lit(0)), lambda m: F.struct(F.lit(1).alias("kind"), strip(F.regexp_extract(m, md.REFERENCE_IMAGE, 1)).alias("alt"), strip(F.regexp_extract(m, md.REFERENCE_IMAGE, 2)).alias("raw"), F.lit("").alias("title")))
    rows = texts.select(KEY, "page_id", "section", F.posexplode(F.concat(inline, by_ref)).alias("at", "i")).withColumn("key", F.when(F.col("i.kind") == 1, F.lower("i.raw")))
    rows = rows.join(definitions.select(KEY, "key", F.col("target").alias("_defined")), [KEY, "key"], "left").withColumn("url_raw", md.clean_target(F.coalesce("_defined", "i.raw")))
    rows = rows.withColumn("to", md.classify_link(F.col("url_raw"), F.col("page_id"), F.col(KEY), vocab)).filter(F.col("to.link_type").isin("wiki_asset", "external", "site_internal"))
    once = F.row_number().over(Window.partitionBy(KEY, "section", "i.alt", "url_raw", "i.title").orderBy("at"))
    rows = rows.withColumn("once", once).filter("once = 1")
    nth = F.row_number().over(Window.partitionBy(KEY, "section").orderBy("at"))
    image = F.struct(F.concat(F.lit("img"), nth.cast("string")).alias("image_id"), F.col("i.alt").alias("alt"), F.col("i.title").alias("title"), "url_raw", "to.url_resolved", "to.link_type", (F.col("i.kind") == 1).alias("is_reference_image"))
    return rows.select(KEY, "section", nth.alias("nth"), image.alias("image"))


def tables_text(tables: Column, max_rows: int = 40) -> Column:
    """Each table's columns and its first rows as lines."""
    one = lambda t, i: F.array_join(F.concat(F.array(F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(": columns: "), F.array_join(t["headers"], ", "))), table_lines(t["headers"], F.slice(t["rows"], 1, max_rows))), "\n")
    return F.array_join(F.transform(tables, one), "\n")


def parse_pages(files: DataFrame, vocab: Vocabulary = Vocabulary(), lang: str = "en") -> DataFrame:  # noqa: B008
    """One document per file of ``files(rel_path, text)``; files below ``news/`` are news posts, all others pages."""
    entries = md.front_matter(F.col("text"))
    news = F.col(KEY).startswith("news/")
    page_id = F.when(news, F.regexp_replace(KEY, r"\.md$", "")).otherwise(F.regexp_replace(KEY, rf"(?:/|^){lang}\.md$", ""))
    pages = materialized(files.select(KEY, "text", entries.alias("matter"), md.body_of(F.col("text")).alias("body"), page_id.alias("page_id"), news.alias("is_news")))
    numbered = materialized(section_lines(page_lines(pages)))
    definitions = materialized(link_definitions(numbered))
    heads = section_heads(numbered)
    marked = materialized(table_marks(content_lines(numbered)))
    tables = section_tables(marked)
    sorted_lines = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("m", "line")))), lambda x: x["line"]), "\n")
    outside, container = F.col("start").isNull(), F.col("line").rlike(md.CONTAINER) & ~F.col("fenced")
    texts = marked.groupBy(KEY, "section").agg(
        sorted_lines(F.lit(True)).alias("whole"), sorted_lines(outside & ~container).alias("main"),
        F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("m", "anchor"))), lambda x: x["anchor"])).alias("anchors"),
        F.transform(F.array_sort(F.collect_list(F.when(outside & container, F.struct("m", "line")))), lambda x: F.struct(F.lit("container").alias("key"), F.coalesce(F.nullif(F.regexp_extract(x["line"], md.CONTAINER, 1), F.lit("")), F.lit("end")).alias("value"))).alias("containers"),
    )
    per_table = tables.groupBy(KEY, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("table", "t"))), lambda x: x["t"]).alias("tables"))
    parts = heads.join(texts, [KEY, "section"], "left").join(per_table, [KEY, "section"], "left").join(pages.select(KEY, "page_id"), KEY)
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    parts = materialized(parts.withColumn("tables", F.coalesce("tables", F.array())).withColumn("main", strip(F.coalesce("main", F.lit("")))).withColumn("whole", F.coalesce("whole", F.lit(""))).withColumn("anchors", empty("anchors", "array<string>")))
    semantic = parts.withColumn("semantic", md.without_code(F.col("main")))
    bodies = F.concat(F.array(F.struct(F.lit(0).alias("part"), F.col("semantic").alias("text"))), F.transform("tables", lambda t, i: F.struct((i + 1).alias("part"), md.without_code(t["raw_markdown"]).alias("text"))))
    spread = semantic.select(KEY, "page_id", "section", "section_id", "heading_path", F.inline(bodies))
    edges = materialized(links_in(spread, definitions, vocab))
    images = images_in(spread.filter("part = 0"), definitions, vocab).groupBy(KEY, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "image"))), lambda x: x["image"]).alias("images"))
    refs = spread.select(KEY, "section", "section_id", F.explode(F.regexp_extract_all("text", F.lit(md.FOOTNOTE_REFERENCE), F.lit(1))).alias("citation_id")).distinct()
    ref_lists = refs.groupBy(KEY, "section").agg(F.array_sort(F.collect_set("citation_id")).alias("citation_refs"))

    full = semantic.withColumn("formulae", md.formulas_of(F.col("whole"))).withColumn("directives", F.concat(md.directives_of(F.col("semantic")), F.coalesce("containers", F.array())))
    table_text, formula_text = tables_text(F.col("tables")), F.when(F.size("formulae") > 0, F.concat(F.lit("Formulas:\n"), F.array_join(F.transform("formulae", lambda f: F.concat(F.lit("- "), f["expression"])), "\n"))).otherwise("")
    text = F.array_join(F.filter(F.array(md.markdown_to_text(F.col("main")), table_text, formula_text), lambda t: t != ""), "\n\n")
    full = full.join(images, [KEY, "section"], "left").join(ref_lists, [KEY, "section"], "left").withColumn("plain", text)
    section = F.struct(
        "section", "section_id", "parent_section_id", "level", "title", "heading_path", F.array_distinct(F.concat(F.array("section_id"), F.col("anchors"))).alias("anchor_ids"), "start_line", "end_line", "directives", "tables",
        F.size("tables").alias("table_count"), "formulae", F.size("formulae").alias("formula_count"), F.coalesce("images", F.array()).alias("images"), F.size(F.coalesce("images", F.array())).alias("image_count"),
        empty("citation_refs", "array<string>").alias("citation_refs"), F.col("plain").alias("text"), F.length("plain").alias("char_count"), F.size(F.filter(F.split("plain", r"(?U)\s+"), lambda w: w != "")).alias("word_count"),
    )
    by_page = full.groupBy(KEY).agg(F.array_sort(F.collect_list(section), lambda a, b: (a["section"] - b["section"]).cast("int")).alias("sections"))
    edge = F.struct("section", "nth", *[c for c in edges.columns if c not in (KEY, "section", "nth")])
    edge_lists = edges.groupBy(KEY).agg(F.array_sort(F.collect_list(edge), lambda a, b: F.when(a["section"] != b["section"], a["section"] - b["section"]).otherwise(a["nth"] - b["nth"]).cast("int")).alias("link_edges"))
    usage = refs.groupBy(KEY, "citation_id").agg(F.array_sort(F.collect_set("section_id")).alias("referenced_in_sections"))
    cited = footnote_definitions(numbered).join(usage, [KEY, "citation_id"], "full").select(
        KEY, F.struct(F.coalesce("line", F.lit(1 << 30)).alias("line"), "citation_id", md.markdown_to_text(F.coalesce("raw_text", F.lit(""))).alias("text"), F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.col("line").alias("defined_at_line"), F.col("line").isNull().alias("missing_definition"), empty("referenced_in_sections", "array<string>").alias("referenced_in_sections")).alias("c")
    )
    cite_lists = cited.groupBy(KEY).agg(F.array_sort(F.collect_list("c")).alias("citations"))
    docs = pages.join(by_page, KEY, "left").join(edge_lists, KEY, "left").join(cite_lists, KEY, "left")
    return described(docs, vocab, lang)


def described(docs: DataFrame, vocab: Vocabulary, lang: str) -> DataFrame:
    """The document's own fields, of pages and of news posts."""
    news, name = F.col("is_news"), F.regexp_replace(F.regexp_extract(KEY, "([^/]*)$", 1), r"\.md$", "")
    matter, topic = F.col("matter"), F.split_part(F.col(KEY), F.lit("/"), F.lit(1))
    series = F.when(news, md.series_of(matter)).otherwise(F.array().cast("array<string>"))
    lists = {c: F.coalesce(F.col(c), F.array()) for c in ("sections", "link_edges", "citations")}
    docs = docs.withColumns(lists).withColumn("series_tags", series)
    first_series = F.get("series_tags", F.lit(0))
    date = F.regexp_extract(name, NEWS_NAME, 1) != ""
    banner = F.get(F.flatten(F.transform("sections", lambda s: s["images"])), F.lit(0))
    title = F.when(news, F.coalesce(F.nullif(strip(md.matter_value(matter, "title")), F.lit("")), F.replace(name, F.lit("-"), F.lit(" ")))).otherwise(md.title_of(F.col("body"), F.col("page_id")))
    total = lambda field: F.aggregate("sections", F.lit(0), lambda s, x: s + x[field])
    link_types = lambda kind: F.size(F.filter("link_edges", lambda e: e["link_type"] == kind))
    no_code = F.regexp_replace("body", md.FENCED, "")
    preview = F.when(news, md.preview_paragraph(F.col("body")))
    iso = F.when(news, md.news_date(md.matter_value(matter, "date")))
    checks = [
        (F.lower(strip(md.matter_value(matter, "layout"))) != "post", "layout_not_post"), (F.size("series_tags") == 0, "missing_series"), (F.col("date_iso").isNull(), "invalid_frontmatter_date"),
        (blank(F.col("preview_paragraph")), "missing_preview_paragraph"), (F.col("banner_image").isNull(), "missing_banner_image"), (no_code.rlike(md.HEADING), "has_h1_heading"),
        (no_code.rlike(md.FOOTNOTE_REFERENCE), "contains_footnotes"), (F.col("title").rlike(r"[*_`~\[\]()]"), "title_contains_markdown"), (F.col("banner_image.alt") != "", "banner_alt_not_empty"),
    ]
    base = vocab.base_url.rstrip("/")
    out = docs.withColumns({"title": title, "preview_paragraph": preview, "date_iso": iso, "banner_image": F.when(news, banner)})
    issues = F.when(news, F.array_compact(F.array(*[F.when(when, F.lit(code)) for when, code in checks]))).otherwise(F.array().cast("array<string>"))
    return out.select(
        F.when(news, "news").otherwise("wiki").alias("source"), F.when(news, "1.0").otherwise("2.0").alias("schema_version"), F.when(~news, F.col("page_id")).alias("page_id"), F.when(news, F.col("page_id")).alias("post_id"),
        F.col("page_id").alias("document_id"), F.col(KEY).alias("repo_rel_path"), F.when(news, F.concat(F.lit(f"{base}/home/news/"), name)).otherwise(F.concat(F.lit(f"{base}/wiki/{lang}/"), F.col("page_id"))).alias("url"),
        F.when(~news, topic).alias("topic"), F.when(news, "news").otherwise(domain_of(F.col(KEY))).alias("domain"), F.when(news, F.coalesce(first_series, F.lit("news"))).otherwise(area_of_path(F.col(KEY), topic)).alias("subculture"),
        F.when(news, F.get(F.split(KEY, "/"), F.lit(1))).alias("year"), F.when(news, F.coalesce(F.nullif(F.regexp_extract(name, NEWS_NAME, 4), F.lit("")), name)).alias("slug"), F.lit(lang).alias("lang"), "title",
        F.when(news, F.array().cast("array<string>")).otherwise(md.matter_list(matter, "tags")).alias("tags"), (F.lower(md.matter_value(matter, "stub")) == "true").alias("is_stub"), "series_tags", first_series.alias("series_primary"),
        "date_iso", F.when(news & date, F.substring(name, 1, 10)).alias("filename_date"), "preview_paragraph", "banner_image", issues.alias("style_issues"),
        F.size("sections").alias("section_count"), F.size("link_edges").alias("edge_count"), F.size("citations").alias("citation_count"), total("table_count").alias("table_count"), total("formula_count").alias("formula_count"), total("image_count").alias("image_count"),
        F.map_from_arrays(F.array(*[F.lit(f"link_type_{k}") for k in ("wiki_article", "wiki_section", "wiki_asset", "site_internal", "external", "mailto", "other")]), F.array(*[link_types(k) for k in ("wiki_article", "wiki_section", "wiki_asset", "site_internal", "external", "mailto", "other")])).alias("stats"),
        "sections", "link_edges", "citations", F.split(KEY, "/").alias("ordinal"),
    )
