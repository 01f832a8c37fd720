"""Chunks: documents exploded into article, section, table, formula and citation units of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import blank, first_filled, let, strip

MAX_CHUNK_CHARS, MAX_TABLE_ROWS, MAX_INTRO_CHARS = 7000, 40, 1400
LEAST_CHARS = 1200  # no limit below this one holds
STRINGS = "array<string>"


def pack(parts: Column, limit: int, separator: str) -> Column:
    """Greedy packing, in order, of parts no longer than the limit; joined by the separator."""
    start = F.struct(F.array().cast(STRINGS).alias("done"), F.lit("").alias("open"))

    def add(s: Column, part: Column) -> Column:
        full = (s["open"] != "") & (F.length(s["open"]) + len(separator) + F.length(part) > limit)
        joined = F.when(s["open"] == "", part).otherwise(F.concat(s["open"], F.lit(separator), part))
        return F.struct(F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"), F.when(full, part).otherwise(joined).alias("open"))

    return F.aggregate(parts, start, add, lambda s: F.filter(F.array_append(s["done"], s["open"]), lambda p: p != ""))


def split_line(line: Column, limit: int) -> Column:
    """A line as packed words; a longer word is cut into slices that stand alone."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    start = F.struct(F.array().cast(STRINGS).alias("done"), F.lit("").alias("open"))

    def add(s: Column, w: Column) -> Column:
        flushed = F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / limit).cast("int")), lambda i: F.substring(w, i * limit + 1, F.lit(limit)))
        long, full = F.length(w) > limit, (s["open"] != "") & (F.length(s["open"]) + 1 + F.length(w) > limit)
        joined = F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))
        return F.struct(
            F.when(long, F.concat(flushed, slices)).when(full, flushed).otherwise(s["done"]).alias("done"), F.when(long, F.lit("")).when(full, w).otherwise(joined).alias("open")
        )

    return F.aggregate(words, start, add, lambda s: F.filter(F.array_append(s["done"], s["open"]), lambda p: p != ""))


def split_text_blocks(text: Column, max_chars: int = MAX_CHUNK_CHARS - 300) -> Column:
    """Parts of at most ``max_chars`` (1,200 at least): packed paragraphs; longer ones by lines, longer lines by words."""
    limit = max(LEAST_CHARS, max_chars)

    def by_line(lines: Column) -> Column:
        return pack(F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > limit, split_line(x, limit)).otherwise(F.array(x)))), limit, "\n\n")

    def split_block(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, r"\r\n|[\n\r\x0B\f\x1c-\x1e\u0085\u2028\u2029]"), strip), lambda x: x != "")
        return let(lines, lambda x: F.when(F.size(x) <= 1, split_line(block, limit)).otherwise(by_line(x)))

    def split_whole(whole: Column) -> Column:
        blocks = F.filter(F.transform(F.split(whole, r"\n(?U)\s*\n"), strip), lambda b: b != "")
        return pack(F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) > limit, split_block(b)).otherwise(F.array(b)))), limit, "\n\n")

    none = F.array().cast(STRINGS)
    return let(strip(F.coalesce(text, F.lit(""))), lambda w: F.when(w == "", none).when(F.length(w) <= limit, F.array(w)).otherwise(split_whole(w)))


def table_lines(headers: Column, rows: Column) -> Column:
    """``Row i: h=v; ...`` for each row with a filled cell; columns beyond the headers are col_i."""

    def line(row: Column, i: Column) -> Column:
        cell = lambda v, j: F.when(~blank(v), F.concat(F.coalesce(F.get(headers, j), F.concat(F.lit("col_"), (j + 1).cast("string"))), F.lit("="), strip(v)))
        pairs = F.array_join(F.array_compact(F.transform(row, cell)), "; ")
        return F.when(pairs != "", F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), pairs))

    return F.array_compact(F.transform(rows, line))


def table_parts(title: Column, section: Column, headers: Column, rows: Column, max_rows: int = MAX_TABLE_ROWS, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Texts of a table: a prefix and as many rows as fit; a row that is too long is split itself, each part alone."""
    columns = F.when(F.size(headers) > 0, F.concat(F.lit("\nColumns: "), F.array_join(headers, ", "))).otherwise("")
    prefix = F.concat(F.lit("Article: "), title, F.lit("\nSection: "), section, columns, F.lit("\n"))
    start = F.struct(F.array().cast(STRINGS).alias("done"), prefix.alias("open"), F.lit(0).alias("n"))

    def add(s: Column, line: Column) -> Column:
        grown = F.concat(s["open"], F.lit("\n"), line)
        full = (s["n"] > 0) & ((s["n"] >= max_rows) | (F.length(strip(grown)) > max_chars))
        long = F.length(line) > max_chars
        done = F.when(full, F.array_append(s["done"], strip(s["open"]))).otherwise(s["done"])
        base, n = F.when(full, prefix).otherwise(s["open"]), F.when(full, 0).otherwise(s["n"])
        own = F.transform(split_text_blocks(line, max_chars - 420), lambda p, i: F.concat(F.when(i == 0, base).otherwise(prefix), F.lit("\n"), p))
        return F.struct(
            F.when(long, F.concat(done, F.transform(own, strip))).otherwise(done).alias("done"),
            F.when(long, prefix).otherwise(F.concat(base, F.lit("\n"), line)).alias("open"),
            F.when(long, 0).otherwise(n + 1).alias("n"),
        )

    return F.aggregate(table_lines(headers, rows), start, add, lambda s: F.when(s["n"] > 0, F.array_append(s["done"], strip(s["open"]))).otherwise(s["done"]))


def root_id(docs: DataFrame) -> Column:
    """Page id, post id or path, the first that is filled."""
    have = [F.col(c) for c in ("page_id", "post_id", "repo_rel_path") if c in docs.columns]
    return F.coalesce(first_filled(*have), F.lit("unknown"))


def article_text(title: Column, fields: list[tuple[str, Column]], preview: Column, intro: Column) -> Column:
    head = [F.concat(F.lit("Title: "), title)] + [F.when(~blank(v), F.concat(F.lit(f"{k}: "), strip(v))) for k, v in fields]
    shown = F.when(~blank(preview), F.concat(F.lit("\nPreview:\n"), strip(preview)))
    begins = F.when(~blank(intro) & (intro != F.coalesce(strip(preview), F.lit(""))), F.concat(F.lit("\nIntro excerpt:\n"), intro))
    return strip(F.array_join(F.array_compact(F.array(*head, shown, begins)), "\n"))


def intro_text(sections: Column, max_chars: int = MAX_INTRO_CHARS) -> Column:
    """The first filled section text, cut with dots."""
    first = F.get(F.filter(F.transform(sections, lambda s: strip(F.coalesce(s["text"], F.lit("")))), lambda t: t != ""), F.lit(0))
    cut = lambda text: F.when(F.length(text) > max_chars, F.concat(F.regexp_replace(F.substring(text, 1, max_chars), r"(?U)\s+$", ""), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))
    return let(first, cut)


def build_chunks(docs: DataFrame, max_chunk_chars: int = MAX_CHUNK_CHARS, max_table_rows: int = MAX_TABLE_ROWS, max_intro_chars: int = MAX_INTRO_CHARS) -> DataFrame:
    """One row per chunk of ``docs``, which have nested sections (with tables and formulae) and citations.

    Everything is a projection and one explode: a document's chunks are made where the document is. chunk_index
    is the place in document order; empty chunks keep theirs and are dropped.
    """
    title = first_filled(F.col("title"), root_id(docs))
    base = docs.withColumn("document_id", root_id(docs)).withColumn("title", title)
    field = lambda name: F.col(name) if name in docs.columns else F.lit(None).cast("string")
    strings = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast(STRINGS)), strip), lambda x: x != "")
    unit = lambda kind, text, suffix="", part=None, section=None: F.struct(
        F.lit(kind).alias("chunk_type"),
        (F.lit(suffix) if isinstance(suffix, str) else suffix).alias("suffix"),
        (F.lit(None).cast("int") if part is None else part).alias("part"),
        (section["section_id"] if section is not None else F.lit(None).cast("string")).alias("section_id"),
        (strings(section["heading_path"]) if section is not None else F.array().cast(STRINGS)).alias("heading_path"),
        strip(text).alias("text"),
    )
    head = article_text(F.col("title"), [("Domain", field("domain")), ("Subculture", field("subculture")), ("Year", field("year")), ("Series", field("series_primary"))], field("preview_paragraph"), intro_text(F.col("sections"), max_intro_chars))

    def of_section(s: Column) -> Column:
        name = first_filled(s["title"], s["section_id"])
        path = F.array_join(strings(s["heading_path"]), " > ")
        lead = F.concat(F.lit("Article: "), F.col("title"), F.lit("\nSection: "), name, F.when(path != "", F.concat(F.lit("\nHeading path: "), path)).otherwise(""), F.lit("\n\n"))
        parts = F.when(~blank(s["section_id"]), split_text_blocks(s["text"], max_chunk_chars - 300)).otherwise(F.array().cast(STRINGS))
        own = let(parts, lambda ps: F.transform(ps, lambda p, i: unit("section", F.concat(lead, p), s["section_id"], F.when(F.size(ps) > 1, i + 1), s)))
        tables = F.flatten(F.transform(F.coalesce(s["tables"], F.array()), lambda t: of_table(s, name, t)))
        formulae = F.transform(
            F.filter(F.coalesce(s["formulae"], F.array()), lambda f: ~blank(f["expression"])),
            lambda f: unit("formula", F.concat(F.lit("Article: "), F.col("title"), F.lit("\nSection: "), name, F.lit("\nFormula ("), F.coalesce(f["source"], F.lit("unknown")), F.lit("): "), strip(f["expression"])), s["section_id"], None, s),
        )
        return F.concat(own, tables, formulae)

    def of_table(s: Column, name: Column, t: Column) -> Column:
        parts = table_parts(F.col("title"), name, strings(t["headers"]), t["rows"], max_table_rows, max_chunk_chars)
        return let(parts, lambda ps: F.transform(ps, lambda p, i: unit("table", p, s["section_id"], F.when(F.size(ps) > 1, i + 1), s)))

    sections = F.flatten(F.transform(F.coalesce(F.col("sections"), F.array()), of_section))
    cited = F.filter(F.coalesce(F.col("citations"), F.array()), lambda c: ~blank(c["citation_id"]) & ~blank(c["text"]))
    citations = F.transform(cited, lambda c: unit("citation", F.concat(F.lit("Article: "), F.col("title"), F.lit("\nCitation "), strip(c["citation_id"]), F.lit(": "), strip(c["text"])), "citation"))
    made = base.select("*", F.posexplode(F.concat(F.array(unit("article", head)), sections, citations)).alias("chunk_index", "unit")).filter(F.col("unit.text") != "")
    kind, part = F.col("unit.chunk_type"), F.col("unit.part")
    return made.select(
        F.concat(
            F.col("document_id"), F.lit("::"), kind,
            F.when(kind != "article", F.concat(F.lit("::"), first_filled(F.col("unit.suffix"), kind))).otherwise(""),
            F.when(part.isNotNull(), F.concat(F.lit("::part-"), part.cast("string"))).otherwise(""),
            F.when(~kind.isin("article", "section"), F.concat(F.lit("::"), F.col("chunk_index").cast("string"))).otherwise(""),
        ).alias("chunk_id"),
        "document_id",
        F.when(F.col("source") == "news", "news").otherwise("wiki").alias("source_type"),
        F.coalesce(F.col("repo_rel_path"), F.lit("")).alias("file_path"),
        F.coalesce(field("url"), F.lit("")).alias("url"),
        "title",
        F.col("unit.text").alias("text"),
        "chunk_index",
        F.when(F.size("unit.heading_path") > 0, F.col("unit.heading_path")).otherwise(F.array("title")).alias("heading_path"),
        F.concat(strings(F.col("tags")), strings(F.col("series_tags") if "series_tags" in docs.columns else F.array().cast(STRINGS))).alias("tags"),
        F.coalesce(field("date_iso"), field("filename_date")).alias("date"),
        field("series_primary").alias("series"),
        kind.alias("chunk_type"),
        field("domain").alias("domain"),
        field("subculture").alias("subculture"),
        F.col("unit.section_id").alias("section_id"),
        part.alias("part"),
    )


def in_document_order(chunks: DataFrame) -> DataFrame:
    """Chunks with their place among all chunks of their document."""
    return chunks.withColumn("nth", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")))
