"""Document sources: JSON files, sitemaps, web pages, markdown folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.text import decode_entities, drop_raw, let
from docsieve.operators.scale import global_rank

DOC_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])


def read_docs(spark: SparkSession, path: str, max_docs: int | None = None, multiline: bool = True) -> DataFrame:
    """``url, text`` of a JSON array (or of JSON lines); null text dropped, an empty result is an error.

    The limit counts rows as read, before null text is dropped. A JSON array
    in one file is one task; write large corpora as JSON lines.
    """
    rows = spark.read.schema(DOC_SCHEMA).json(path, multiLine=multiline)
    rows = rows.limit(max_docs) if max_docs else rows
    docs = rows.where(F.col("text").isNotNull())
    if docs.isEmpty():
        raise ValueError(f"no documents found in {path}")
    return docs


def sitemap_urls(xml: DataFrame, col: str = "value", max_docs: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``position, url`` of every ``<loc>`` in whole-text sitemap rows, in file order, beside the other columns.

    ``max_docs`` limits the whole list: the first addresses by ``order`` of the
    sitemaps and position in them.
    """
    locs = F.regexp_extract_all(F.col(col), F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))
    locs = F.transform(locs, decode_entities)
    if max_docs:
        locs = F.slice(locs, 1, max_docs)
    urls = xml.select(*[c for c in xml.columns if c != col], F.posexplode(locs).alias("position", "url"))
    return urls.orderBy(*(order or []), "position").limit(max_docs) if max_docs else urls


def article_html(html: Column, element: str = "article", css_class: str | None = None) -> Column:
    """The first element of that name (and class) with its tags, else null.

    Elements of the same name may be nested in it; one that is never closed
    runs to the end of the page. Text inside scripts, styles and comments
    cannot open an element.
    """
    attrs = rf"""\b[^>]*\bclass=["']{css_class}["'][^>]*>""" if css_class else r"\b[^>]*>"
    return let(drop_raw(html, ""), lambda quiet: _first_element(quiet, element, attrs))


def _first_element(quiet: Column, element: str, attrs: str) -> Column:
    # No tag ends behind the last ">".
    start = F.regexp_instr(F.left(quiet, F.length(quiet) - F.length(F.substring_index(quiet, ">", -1))), F.lit(rf"(?is)<{element}{attrs}"))
    # Pieces begin with an opening or closing tag of the element.
    pieces = F.split(F.substring(quiet, F.greatest(start, F.lit(1)), F.length(quiet)), rf"(?i)(?=</?{element}\b)")
    zero = F.lit(0)
    begin = F.struct(zero.alias("depth"), zero.alias("at"), zero.alias("end"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(F.startswith(piece, F.lit("</")), -1).otherwise(1)
        at = state["at"] + 1
        end = F.when((state["end"] == 0) & (depth == 0), at).otherwise(state["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    def whole(p: Column) -> Column:
        end = F.aggregate(p, begin, step, lambda s: s["end"])
        closing = F.regexp_extract(F.get(p, end - 1), rf"(?is)^</{element}\b[^>]*>", 0)
        return F.when(end > 0, F.concat(F.array_join(F.slice(p, 1, end - 1), ""), closing)).otherwise(F.array_join(p, ""))

    # A one-element array gives the pieces a name, so that they are made once.
    return F.when(start > 0, F.transform(F.array(pieces), whole)[0])


def extract_article(pages: DataFrame, element: str = "article", css_class: str | None = None) -> DataFrame:
    """``url, text`` with the content element of each page; pages without one are dropped."""
    out = pages.select("url", article_html(F.col("html"), element, css_class).alias("text"))
    return out.where(F.col("text").isNotNull())


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources by column name; a column missing in one is null there."""
    if not sources:
        raise ValueError("no sources")
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def corpus_stats(docs: DataFrame, text: str = "text", suspect: int = 5000) -> DataFrame:
    """One row: documents, mean and longest length, and how many end exactly at ``suspect``."""
    n = F.coalesce(F.length(text), F.lit(0))
    return docs.agg(
        F.count("*").alias("docs"),
        F.avg(n).alias("avg_chars"),
        F.max(n).cast("bigint").alias("max_chars"),
        F.coalesce(F.sum(F.when(n == suspect, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("truncated"),
    )


def read_markdown_corpus(spark: SparkSession, path: str, files: str = "*.md") -> DataFrame:
    """``name, description, content, folder`` of each markdown file below ``path``.

    ``files`` is the pattern of their names. Name and description come from the front matter; the name falls back to
    the folder (or, at the top level, the file).
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path, wholetext=True)
    where = F.regexp_replace(F.input_file_name(), "%20", " ")
    stem = F.regexp_extract(where, r"([^/]+)\.[^./]+$", 1)
    folder = F.regexp_extract(where, r"([^/]+)/[^/]+$", 1)
    rows = files.select(
        F.when((F.upper(stem) == "SKILL") | F.startswith(stem, F.lit("part-")), folder).otherwise(stem).alias("folder"), F.col("value").alias("content")
    )
    return front_matter(rows)


def front_matter(rows: DataFrame) -> DataFrame:
    """Add ``name`` and ``description`` from the front matter of ``content``."""
    head = F.regexp_extract("content", r"(?s)\A---[^\S\n]*\n(.*?)\n---", 1)

    def field(name: str) -> Column:
        found = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
        return F.when(found != "", found)

    return rows.select(
        F.coalesce(field("name"), F.col("folder")).alias("name"),
        F.coalesce(field("description"), F.lit("")).alias("description"),
        "content", "folder",
    )


def corpus_index(corpus: DataFrame) -> DataFrame:
    """Numbered entries ``line_no, line`` in name order: the index of a markdown corpus.

    One row per entry, so the index of a large corpus never becomes one value.
    """
    ranked = global_rank(corpus.select("name", "folder", "description"), ["name", "folder"])
    text = F.concat(F.lit("**"), F.col("name"), F.lit("**: "), F.col("description"))
    numbered = ranked.select((F.col("_rank") + 1).alias("line_no"), text.alias("entry"))
    return numbered.select("line_no", F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("entry")).alias("line"))


def index_text(index: DataFrame) -> DataFrame:
    """The whole index as one text, for a prompt: call it on a corpus that fits one."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return index.agg(F.array_join(lines, "\n").alias("index_text"))
