"""Sources and text preparation on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators import text as op
from docsieve.plans.registry import query, table, text_table
from docsieve.session import scratch_path
from docsieve.sources import docs as src
from docsieve.sources import tables as tb

# ---------------------------------------------------------------- SQL fragments

_WS = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def sql_clean(x: str) -> str:
    s = f"regexp_replace(coalesce({x}, ''), '<!--.*?-->|<script\\b[^>]*>.*?(?:</script\\s*>|\\z)|<style\\b[^>]*>.*?(?:</style\\s*>|\\z)', '<br>', 'gis')"
    s = f"regexp_replace({s}, '<nav\\b[^>]*>.*?</nav\\s*>|<footer\\b[^>]*>.*?</footer\\s*>|<header\\b[^>]*>.*?</header\\s*>', '<br>', 'gis')"
    s = f"regexp_replace({s}, '(?:</?[A-Za-z][^>]*>|<![^>]*>|<\\?[^>]*>)+', chr(10), 'gs')"
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        s = f"replace({s}, '&{name};', '{char}')"
    s = f"regexp_replace(regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')"
    return sql_strip(s)


def sql_fixed(source: str, text: str, keys: str, size: int, overlap: int) -> str:
    """Fixed chunks ``keys, chunk_index, chunk_text`` of a relation."""
    step = size - overlap
    return f"""
      SELECT {keys}, i AS chunk_index,
             CASE WHEN length({text}) <= {size} THEN {text} ELSE substring({text}, i * {step} + 1, {size}) END AS chunk_text
      FROM {source}, unnest(range(CASE WHEN length({text}) = 0 THEN 0 WHEN length({text}) <= {size} THEN 1
                                  ELSE (length({text}) - 1) // {step} + 1 END)) AS g(i)
      WHERE {text} IS NOT NULL"""


def sql_sentence(text: str, size: int, overlap: int) -> str:
    """Sentence chunks of one text as a list."""
    return sql_pack(f"string_split(regexp_replace({text}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1))", size, overlap, "' '", 1)


def sql_pack(parts: str, size: int, overlap: int, glue: str, glue_length: int) -> str:
    """A list of texts packed in order: what is packed and what is still open."""
    fits = f"length(a.cur) + length(x.cur) + {glue_length} <= {size}"
    grown = f"CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || {glue} || x.cur END"
    tail = f"right(a.cur, {overlap}) || {glue} || x.cur" if overlap else "x.cur"
    return f"""list_reduce(
        list_prepend({{'cur': '', 'out': CAST([] AS VARCHAR[])}},
                     list_transform({parts}, lambda s: {{'cur': s, 'out': CAST([] AS VARCHAR[])}})),
        lambda a, x: {{'cur': CASE WHEN {fits} THEN {grown} WHEN a.cur = '' THEN x.cur ELSE {tail} END,
                   'out': CASE WHEN {fits} OR a.cur = '' THEN a.out ELSE list_append(a.out, {sql_strip('a.cur')}) END}})"""


# ---------------------------------------------------------------- sources


@query("a01_read_docs", "SELECT url, CAST(length(html) AS BIGINT) AS n_chars FROM pages WHERE html IS NOT NULL")
def a01(spark, sf):
    path = scratch_path(spark, "docs-json")
    table(spark, sf, "pages").select("url", F.col("html").alias("text")).write.json(path)
    return src.read_docs(spark, path, multiline=False).select("url", F.length("text").cast("bigint").alias("n_chars"))


def _sitemaps(spark, sf):
    """A sitemap for every fifty pages, as whole-text rows."""
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    rows = table(spark, sf, "pages").groupBy(F.expr("page_id div 50").alias("sitemap")).agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("rows"))
    entries = F.array_join(F.transform("rows", lambda r: r["e"]), "\n")
    return rows.select("sitemap", F.concat(F.lit("<urlset>\n"), entries, F.lit("\n</urlset>")).alias("value"))


_SITEMAP_SQL = "SELECT page_id // 50 AS sitemap, CAST(row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS INTEGER) AS position, url FROM pages"


@query("a02_sitemap_urls", _SITEMAP_SQL)
def a02(spark, sf):
    return src.sitemap_urls(_sitemaps(spark, sf))


@query("a02_sitemap_first", f"SELECT * FROM ({_SITEMAP_SQL}) ORDER BY sitemap, position LIMIT 70")
def a02_first(spark, sf):
    # The limit is one over all sitemaps, in their order.
    return src.sitemap_urls(_sitemaps(spark, sf), max_docs=70, order=["sitemap"])


_ARTICLE = r"nullif(regexp_extract(regexp_replace(html, '<!--.*?-->|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)', '', 'gis'), '(?is)<article\b[^>]*>.*?</article\s*>', 0), '')"


@query("a03_extract_article", f"SELECT url, md5({_ARTICLE}) AS digest FROM pages WHERE {_ARTICLE} IS NOT NULL")
def a03(spark, sf):
    return src.extract_article(table(spark, sf, "pages")).select("url", F.md5("text").alias("digest"))


@query("a04_union_sources", """
  SELECT source, count(*) AS docs FROM (
    SELECT 'pages' AS source, html AS text FROM pages UNION ALL
    SELECT source, text FROM documents UNION ALL
    SELECT 'benchmark' AS source, text FROM benchmark) GROUP BY source""")
def a04(spark, sf):
    parts = [
        table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("text"), "url"),
        table(spark, sf, "documents").select("source", "text"),
        table(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("source")),
    ]
    return src.union_sources(*parts).groupBy("source").agg(F.count("*").alias("docs"))


@query("a05_save_overwrite", "SELECT lang, count(*) AS docs FROM documents GROUP BY lang")
def a05(spark, sf):
    path = scratch_path(spark, "table")
    name = f"docsieve_docs_{path[-12:]}"
    docs = table(spark, sf, "documents")
    tb.save_overwrite(docs.select("doc_id"), name, path)
    tb.save_overwrite(docs.select("doc_id", "lang"), name, path)
    return tb.forget_table(spark, name).groupBy("lang").agg(F.count("*").alias("docs"))


@query("a06_save_append", """
  SELECT doc_id, quality, toxic FROM labels
  UNION ALL SELECT doc_id, NULL AS quality, NULL AS toxic FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def a06(spark, sf):
    path = scratch_path(spark, "append")
    labels = table(spark, sf, "labels")
    tb.save_append(labels, path)
    tb.save_append(table(spark, sf, "documents").join(labels, "doc_id", "left_anti").select("doc_id"), path)
    return tb.read_merged(spark, path)


@query("a07_table_or_load", "SELECT count(*) AS docs, count(DISTINCT source) AS sources FROM documents")
def a07(spark, sf):
    path = scratch_path(spark, "table")
    name = f"docsieve_load_{path[-12:]}"
    load = lambda: table(spark, sf, "documents").select("doc_id", "source")
    tb.table_or_load(spark, name, load, path)
    tb.table_or_load(spark, name, load, path)
    return tb.forget_table(spark, name).agg(
        F.count("*").alias("docs"), F.countDistinct("source").alias("sources")
    )


@query("a08_resolve_dataset", """
  SELECT n.n_nationkey AS scope, coalesce(t.name, n.n_name) AS dataset
  FROM nation n LEFT JOIN (SELECT s_nationkey, min(s_name) AS name FROM supplier GROUP BY s_nationkey) t
    ON t.s_nationkey = n.n_nationkey""")
def a08(spark, sf):
    shared = table(spark, sf, "nation").select(F.col("n_nationkey").alias("scope"), F.col("n_name").alias("dataset"))
    team = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("scope")).agg(
        F.min("s_name").alias("dataset")
    )
    return tb.resolve_dataset(team, shared, "scope", ["dataset"])


@query("a09_corpus_stats", """
  SELECT count(*) AS docs, round(avg(length(text)), 4) AS avg_chars, CAST(max(length(text)) AS BIGINT) AS max_chars,
         CAST(sum(CASE WHEN length(text) = 5000 THEN 1 ELSE 0 END) AS BIGINT) AS truncated FROM documents""")
def a09(spark, sf):
    return src.corpus_stats(table(spark, sf, "documents")).withColumn("avg_chars", F.round("avg_chars", 4))


def _markdown(spark, sf):
    """Each document as a markdown file's content with front matter."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("folder"),
        F.when(
            F.col("doc_id") % 3 == 0, F.concat(F.lit("# no front matter\n"), F.col("text"))
        ).otherwise(F.concat(
            F.lit("---\nname: note-"), F.col("doc_id").cast("string"), F.lit("\ndescription: from "), F.col("source"),
            F.lit("\n---\n"), F.col("text"),
        )).alias("content"),
    )


_MARKDOWN_SQL = """
  SELECT 'doc' || doc_id AS folder, CASE WHEN doc_id % 3 = 0 THEN 'doc' || doc_id ELSE 'note-' || doc_id END AS name,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'from ' || source END AS description FROM documents"""


@query("a10_markdown_corpus", _MARKDOWN_SQL)
def a10(spark, sf):
    return src.front_matter(_markdown(spark, sf)).drop("content")


@query("a10_markdown_files", """
  SELECT 'maker=' || maker AS folder, CASE WHEN maker % 3 = 0 THEN 'maker=' || maker ELSE 'maker ' || maker END AS name, CASE WHEN maker % 3 = 0 THEN '' ELSE 'parts of ' || maker END AS description,
    md5(CASE WHEN maker % 3 = 0 THEN '# parts' ELSE '---' || chr(10) || 'name: "maker ' || maker || '"' || chr(10) || 'description: parts of ' || maker || chr(10) || '---' END || chr(10) || names) AS digest
  FROM (SELECT p_partkey % 40 AS maker, string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) AS names FROM part GROUP BY 1)""")
def a10_files(spark, sf):
    """A folder for every maker, written and read back as files."""
    maker = F.col("maker").cast("string")
    rows = table(spark, sf, "part").groupBy((F.col("p_partkey") % 40).alias("maker")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("- "), "p_name").alias("n")))).alias("ps"))
    head = F.when(F.col("maker") % 3 == 0, "# parts").otherwise(F.concat(F.lit('---\nname: "maker '), maker, F.lit('"\ndescription: parts of '), maker, F.lit("\n---")))
    path = scratch_path(spark, "markdown")
    rows.select("maker", F.concat(head, F.lit("\n"), F.array_join(F.transform("ps", lambda p: p["n"]), "\n")).alias("value")).repartition("maker").write.partitionBy("maker").text(path)
    out = src.read_markdown_corpus(spark, path, "*.txt")
    # The writer ends a file with a line break.
    digest = F.md5(F.regexp_replace("content", r"\n\z", ""))
    return out.select(F.regexp_extract("folder", r"^(.*)$", 1).alias("folder"), "name", "description", digest.alias("digest"))


@query("a11_corpus_index", f"""
  SELECT n AS line_no, n || '. **' || name || '**: ' || description AS line
  FROM (SELECT name, description, row_number() OVER (ORDER BY name, folder) AS n FROM ({_MARKDOWN_SQL}))""")
def a11(spark, sf):
    return src.corpus_index(src.front_matter(_markdown(spark, sf)))


# ---------------------------------------------------------------- cleaning and chunks


@query("a12_clean_html", f"SELECT page_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT page_id, {sql_clean('html')} AS t FROM pages)")
def a12(spark, sf):
    cleaned = op.clean_html(text_table(spark, sf, "pages"), "html", "t")
    return cleaned.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query("a13_chunk_fixed", f"""
  SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk_text) AS digest
  FROM ({sql_fixed('documents', 'text', 'doc_id', 1000, 200)})""")
def a13(spark, sf):
    out = op.chunk(text_table(spark, sf, "documents").select("doc_id", "text"), "text", "fixed")
    return out.select("doc_id", "chunk_index", F.md5("chunk_text").alias("digest"))


@query("a14_chunk_sentence", f"""
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(c[i + 1]) AS digest FROM (
    SELECT doc_id, CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 1000 THEN [text]
        WHEN {sql_strip('st.cur')} <> '' THEN list_append(st.out, {sql_strip('st.cur')}) ELSE st.out END AS c
    FROM (SELECT doc_id, text, {sql_sentence('text', 1000, 200)} AS st FROM documents)), unnest(range(len(c))) AS g(i)""")
def a14(spark, sf):
    out = op.chunk(text_table(spark, sf, "documents").select("doc_id", "text"), "text", "sentence")
    return out.select("doc_id", "chunk_index", F.md5("chunk_text").alias("digest"))


def _closed(packed: str) -> str:
    return f"list_transform([{packed}], lambda p: CASE WHEN {sql_strip('p.cur')} <> '' THEN list_append(p.out, {sql_strip('p.cur')}) ELSE p.out END)[1]"


# Runs of short paragraphs and single long ones, then chunks of each.
_RUNS_SQL = """list_reduce(
    list_prepend({'run': CAST([] AS VARCHAR[]), 'runs': CAST([] AS VARCHAR[][])}, list_transform(paras, lambda p: {'run': [p], 'runs': CAST([] AS VARCHAR[][])})),
    lambda a, x: CASE WHEN length(x.run[1]) > 1000
      THEN {'run': CAST([] AS VARCHAR[]), 'runs': list_append(CASE WHEN len(a.run) > 0 THEN list_append(a.runs, a.run) ELSE a.runs END, x.run)}
      ELSE {'run': list_append(a.run, x.run[1]), 'runs': a.runs} END)"""


@query("a15_chunk_semantic", f"""
  WITH d AS (SELECT doc_id, regexp_replace(text, '\\n([^\\n]*)\\n([^\\n]*)\\n', chr(10) || '\\1' || chr(10) || chr(10) || '\\2' || chr(10) || chr(10), 'g') AS t FROM documents),
    p AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '\\n\\n+'), lambda s: {sql_strip('s')}), lambda s: s <> '') AS paras FROM d),
    r AS (SELECT doc_id, t, {_RUNS_SQL} AS f FROM p),
    c AS (SELECT doc_id, CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 1000 THEN [t] ELSE flatten(list_transform(
        CASE WHEN len(f.run) > 0 THEN list_append(f.runs, f.run) ELSE f.runs END,
        lambda r: CASE WHEN length(r[1]) > 1000 THEN {_closed(sql_sentence('r[1]', 1000, 200))} ELSE {_closed(sql_pack('r', 1000, 200, "chr(10) || chr(10)", 2))} END)) END AS c FROM r)
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(c[i + 1]) AS digest FROM c, unnest(range(len(c))) AS g(i)""")
def a15(spark, sf):
    # Every third line break opens a paragraph, so that paragraphs exist.
    docs = text_table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", r"\n([^\n]*)\n([^\n]*)\n", "\n$1\n\n$2\n\n").alias("text")
    )
    out = op.chunk(docs, "text", "semantic")
    return out.select("doc_id", "chunk_index", F.md5("chunk_text").alias("digest"))


@query("a16_chunk_strategies", f"""
  SELECT 'fixed' AS strategy, count(*) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS chars
  FROM ({sql_fixed('documents', 'text', 'doc_id', 500, 50)})
  UNION ALL
  SELECT 'sentence', count(*), CAST(sum(length(x)) AS BIGINT) FROM (SELECT unnest(
    CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 500 THEN [text]
        WHEN {sql_strip('st.cur')} <> '' THEN list_append(st.out, {sql_strip('st.cur')}) ELSE st.out END) AS x
    FROM (SELECT doc_id, text, {sql_sentence('text', 500, 50)} AS st FROM documents))""")
def a16(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    parts = [op.chunk(docs, "text", s, 500, 50).select(F.lit(s).alias("strategy"), "chunk_text") for s in ("fixed", "sentence")]
    return src.union_sources(*parts).groupBy("strategy").agg(
        F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).cast("bigint").alias("chars")
    )


_CLEAN_PAGES = f"(SELECT url, {sql_clean('html')} AS t FROM pages)"
SQL_PAGE_CHUNKS = f"""
  SELECT url, url || '_' || chunk_index AS chunk_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_text
  FROM ({sql_fixed(_CLEAN_PAGES, 't', 'url', 1000, 200)}) WHERE length(chunk_text) >= 50"""


def page_chunks(spark, sf):
    return op.build_chunks(text_table(spark, sf, "pages"), "url", "html", "fixed")


@query("a17_build_chunks", f"SELECT url, chunk_id, chunk_index, md5(chunk_text) AS digest FROM ({SQL_PAGE_CHUNKS})")
def a17(spark, sf):
    return page_chunks(spark, sf).select("url", "chunk_id", "chunk_index", F.md5("chunk_text").alias("digest"))


@query("a18_sync_changes", """
  WITH old AS (SELECT doc_id, text, lang FROM documents WHERE source <> 'src1'),
       new AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text, lang FROM documents WHERE source <> 'src2')
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
         CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change
  FROM old o FULL JOIN new n ON o.doc_id = n.doc_id
  WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text <> n.text OR o.lang <> n.lang""")
def a18(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    # Two snapshots of the table: one source came, one went, the French texts changed.
    old = docs.where("source <> 'src1'").drop("source")
    new = docs.where("source <> 'src2'").drop("source").withColumn(
        "text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    )
    return op.sync_changes(old, new, "doc_id")
