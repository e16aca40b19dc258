"""Queries of vector retrieval, full-text search, chunking and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions import text as t
from quillmesh.operators import chunking, fulltext, labels, learning, retrieval
from quillmesh.plans.registry import query, table

c = F.col

_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v)"
_KNN = f"{_VEC}, s AS (SELECT q.vec_id AS query, q.label, r.vec_id, r.label AS got, list_dot_product(q.e, r.e) / (q.n * r.n) AS score FROM u q JOIN u r ON q.vec_id % 20 = 0)"


@query(f"WITH {_KNN}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) SELECT query, rank, vec_id, round(score, 4) AS score FROM k WHERE rank <= 5")
def w1_f8_f9_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.knn(rows, rows.where("vec_id % 20 = 0"), 5).select("query", "rank", "vec_id", F.round("score", 4).alias("score"))


_OTHERS = f"{_KNN}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s WHERE query <> vec_id), f AS (SELECT * FROM k WHERE rank <= 5)"


@query(f"""WITH {_OTHERS}, p AS (SELECT query, label, max(CASE WHEN rank = 1 AND got = label THEN 1.0 ELSE 0 END) AS a, max(CASE WHEN got = label THEN 1.0 ELSE 0 END) AS b, max(score) AS m FROM f GROUP BY query, label)
SELECT label, count(*) AS queries, round(avg(CAST(a AS DOUBLE)), 4) AS top1, round(avg(CAST(b AS DOUBLE)), 4) AS topk, round(avg(m), 4) AS best, round(median(m), 4) AS median_best FROM p GROUP BY label""")
def a8_retrieval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.knn(rows, rows.where("vec_id % 20 = 0"), 5, others_only=True)
    return retrieval.hit_rates(found, rows).select("label", "queries", *[F.round(k, 4).alias(k) for k in ("top1", "topk", "best", "median_best")])


@query("WITH f AS (SELECT DISTINCT label AS fold FROM embeddings ORDER BY label LIMIT 3) SELECT fold, vec_id, CASE WHEN label = fold THEN 'test' ELSE 'train' END AS role FROM embeddings CROSS JOIN f")
def a20_leave_one_group_out(spark, sf_dir):
    """The first three groups are the folds; that is the feature, not a cap."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    folds = rows.select(c("label").alias("fold")).distinct().orderBy("fold").limit(3)
    return rows.join(F.broadcast(folds)).select("fold", "vec_id", F.when(c("label") == c("fold"), "test").otherwise("train").alias("role"))


@query(f"WITH {_OTHERS} SELECT query % 3 AS fold, count(*) AS n, round(avg(CASE WHEN got = label THEN 1.0 ELSE 0 END), 4) AS accuracy FROM f WHERE rank = 1 GROUP BY 1")
def a21_fold_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.knn(rows, rows.where("vec_id % 20 = 0"), 1, others_only=True)
    of = rows.select(c("vec_id").alias("k"), "label")
    hits = found.join(of.select(c("k").alias("query"), "label"), "query").join(of.select(c("k").alias("vec_id"), c("label").alias("got")), "vec_id")
    return hits.groupBy((c("query") % 3).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((c("got") == c("label")).cast("double")), 4).alias("accuracy"))


@query()
def k4_embedding_classifier(spark, sf_dir):
    """Labels of every embedding by a network that was trained on four fifths of them; the rest is held out."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    model = learning.train(rows.where("vec_id % 5 <> 0"))
    return learning.predicted(rows, model).select("vec_id", "label", (c("vec_id") % 5 == 0).alias("held_out"), "predicted", F.round("confidence", 4).alias("confidence"))


# ---- full-text search

_STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
_TOKENS = "regexp_extract_all(lower({}), '[A-Za-z0-9_]+')"
_SEARCH = f"""d AS (SELECT doc_id AS chunk, {_TOKENS.format("split_part(text, chr(10), 1)")} AS s, {_TOKENS.format("text")} AS b FROM documents), dl AS (SELECT chunk, len(s) + len(b) AS dl FROM d),
each AS (SELECT chunk, unnest(s) AS term, 4 AS w FROM d UNION ALL SELECT chunk, unnest(b), 1 FROM d),
words AS (SELECT DISTINCT item_id AS question, term FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) WHERE term NOT IN ({_STOP})),
p AS (SELECT chunk, term, sum(w) AS tf FROM each WHERE term IN (SELECT term FROM words) GROUP BY chunk, term), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), g AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
scored AS (SELECT question, p.chunk, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score, count(*) AS have FROM words JOIN p USING (term) JOIN df USING (term) JOIN dl ON dl.chunk = p.chunk CROSS JOIN g GROUP BY question, p.chunk),
first30 AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9), chunk) AS pl FROM scored QUALIFY pl <= 30),
need AS (SELECT question, greatest(1, CAST(ceil(round(0.6 * count(*), 9)) AS BIGINT)) AS need FROM words GROUP BY question),
answers AS (SELECT f.question, row_number() OVER (PARTITION BY f.question ORDER BY pl) AS place, chunk, score FROM first30 f JOIN need USING (question) WHERE have >= need QUALIFY place <= 3)"""


def _search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("section"))
    return docs, fulltext.search(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 3)


@query(f"WITH {_SEARCH} SELECT question, place, chunk, round(score, 4) AS score FROM answers")
def f37_f38_j4_t4_search(spark, sf_dir):
    return _search(spark, sf_dir)[1].select("question", "place", "chunk", F.round("score", 4).alias("score"))


@query(f"""WITH {_SEARCH}, h AS (SELECT b.item_id, min(CASE WHEN contains(d.text, left(b.text, 30)) THEN place END) AS first_hit FROM benchmark b LEFT JOIN answers a ON a.question = b.item_id LEFT JOIN documents d ON d.doc_id = a.chunk GROUP BY b.item_id)
SELECT count(*) AS questions, count(first_hit) AS found, count(*) FILTER (WHERE first_hit = 1) AS found_first FROM h""")
def a22_search_recall(spark, sf_dir):
    docs, found = _search(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 30).alias("phrase"))
    hit = found.join(docs.select(c("doc_id").alias("chunk"), "text"), "chunk").join(asked, c("question") == c("item_id")).where(c("text").contains(c("phrase")))
    first = asked.join(hit.groupBy("item_id").agg(F.min("place").alias("first_hit")), "item_id", "left")
    return first.agg(F.count(F.lit(1)).alias("questions"), F.count("first_hit").alias("found"), F.count_if(c("first_hit") == 1).alias("found_first"))


_WORDS_OF = f"(SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark)"
_CASES = _SEARCH.replace(_WORDS_OF, f"(SELECT item_id, term FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term, ({_TOKENS.format('text')})[1] AS model FROM benchmark) WHERE term <> model)")


@query(f"""WITH {_CASES}, c AS (SELECT item_id, CASE WHEN item_id % 4 <> 0 THEN lower(text) END AS phrase FROM benchmark),
h AS (SELECT c.item_id, phrase, count(a.chunk) AS hits, min(CASE WHEN contains(lower(d.text), phrase) THEN place END) AS rank FROM c LEFT JOIN answers a ON a.question = c.item_id LEFT JOIN documents d ON d.doc_id = a.chunk GROUP BY c.item_id, phrase)
SELECT item_id AS question, hits, rank, CASE WHEN phrase IS NULL THEN 'info' WHEN rank IS NULL THEN 'missed' ELSE 'found' END AS verdict FROM h""")
def a22_retrieval_cases(spark, sf_dir):
    """Each item asks for the document that holds it, its first word being the model, which is not asked for; every fourth has no phrase and is only told."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("section"))
    cases = table(spark, sf_dir, "benchmark").select("item_id", "text", t.tokens(c("text"))[0].alias("model"), F.when(c("item_id") % 4 != 0, c("text")).alias("phrase"))
    return fulltext.judged(fulltext.search(docs, cases, "doc_id", "item_id", 3), docs, cases, "doc_id", "item_id")


_COLLAPSE = "lower(trim(regexp_replace({}, '[\\s\u00a0]+', ' ', 'g')))"


@query(f"WITH q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark)), d AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents)) SELECT item_id, doc_id, count(*) AS common FROM q JOIN d USING (term) GROUP BY item_id, doc_id")
def o4_common_words(spark, sf_dir):
    """Texts that share words, and how many: an equi-join on words."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(t.tokens(c("text")))).alias("term"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(t.tokens(c("text")))).alias("term"))
    return q.join(d, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("common"))


# ---- text functions


@query("SELECT p_partkey, regexp_replace(upper(p_name || '-' || p_brand), '[^A-Z0-9]', '', 'g') AS norm, translate(regexp_replace(upper(p_name || '-' || p_brand), '[^A-Z0-9]', '', 'g'), 'OILSZB', '011528') AS folded FROM part")
def f22_f23_norm_fold(spark, sf_dir):
    name = F.concat_ws("-", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", t.norm(name).alias("norm"), t.fold_confusions(t.norm(name)).alias("folded"))


@query()
def f24_w2_label_match(spark, sf_dir):
    """The best label of each text, unless it is too unlike or the second best is too near; texts of less than two letters have none. The ratio is Python's difflib."""
    names = table(spark, sf_dir, "part").select(c("p_type").alias("tag"), F.lit(0).alias("place"), c("p_type").alias("alias")).distinct()
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.substring("p_type", 1, c("p_partkey") % 6), F.lit(" "), F.when(c("p_size") % 3 > 0, c("p_size"))).alias("read"), "p_type")
    texts = texts.withColumn("read", F.coalesce("read", F.substring("p_type", 1, 1)))
    found = labels.best_tags(texts, names)
    return texts.join(found, "read").select("p_partkey", "label", F.round("score", 4).alias("score"))


@query()
def f24_w2_several_aliases(spark, sf_dir):
    """Names of two aliases each (as they are, and their words turned round): the best of all aliases, and of first ones alone."""
    part = table(spark, sf_dir, "part")
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    names = part.select(c("p_name").alias("tag"), F.explode(F.array(F.struct(F.lit(0).alias("place"), c("p_name").alias("alias")), F.struct(F.lit(1).alias("place"), turned.alias("alias")))).alias("a")).select("tag", "a.*").distinct()
    k = c("p_partkey") % 4
    read = F.when(k == 0, turned).when(k == 1, F.expr("substring(p_name, 1, length(p_name) - 2)")).when(k == 2, F.concat("p_size", turned)).otherwise(F.translate("p_name", "olisz", "01152"))
    texts = part.select("p_partkey", read.alias("read"))
    every, first = labels.best_tags(texts, names), labels.best_tags(texts, names, first_only=True).select("read", c("label").alias("first_label"), c("score").alias("first_score"))
    return texts.join(every, "read").join(first, "read").select("p_partkey", "label", F.round("score", 4).alias("score"), "first_label", F.round("first_score", 4).alias("first_score"))


@query(f"SELECT item_id, array_to_string(list_filter({_TOKENS.format('text')}, lambda w: w NOT IN ({_STOP}) AND w NOT IN ('er', 'la')), ' ') AS terms FROM benchmark")
def f25_question_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(t.question_terms(c("text"), F.array(F.lit("er"), F.lit("la"))), " ").alias("terms"))


@query(f"""SELECT item_id, {_COLLAPSE.format("text")} AS collapsed, regexp_replace({_COLLAPSE.format("item_id || '.2  Page ' || text")}, '[0-9]+', '#', 'g') AS margin, regexp_replace(trim(item_id || '.2 ' || text), '^([A-Z]\\.)?[0-9.]*[0-9]\\.?\\s+', '') AS title FROM benchmark""")
def f26_text_keys(spark, sf_dir):
    numbered = F.concat(c("item_id").cast("string"), F.lit(".2  Page "), "text")
    title = t.strip_number(F.concat(c("item_id").cast("string"), F.lit(".2 "), "text"))
    return table(spark, sf_dir, "benchmark").select("item_id", t.collapse(c("text")).alias("collapsed"), t.margin_key(numbered).alias("margin"), title.alias("title"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '2NGA' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHEN s_suppkey % 3 = 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS number, CASE WHEN s_suppkey % 3 = 0 THEN 'manual' WHEN s_suppkey % 3 = 1 THEN 'technical manual' END AS type FROM supplier")
def f27_document_names(spark, sf_dir):
    k = c("s_suppkey")
    six = F.lpad(k.cast("string"), 6, "0")
    stem = F.when(k % 3 == 0, F.concat(F.lit("MA_x_2NGA"), six)).when(k % 3 == 1, F.concat(F.lit("Relay TM "), six)).otherwise(F.concat(F.lit("sheet "), six, F.lit("7")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.document_number(stem).alias("number"), t.document_type(stem).alias("type"))


# ---- chunking

_LINES = "lines AS (SELECT doc_id, unnest(range(0, len(l))) AS ord, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


@query(f"""WITH RECURSIVE {_LINES}, w AS (SELECT doc_id, ord, CAST(0 AS INT) AS chunk, length(line) AS size FROM lines WHERE ord = 0 UNION ALL
SELECT l.doc_id, l.ord, CAST(CASE WHEN w.size + 1 + length(l.line) > 2200 THEN w.chunk + 1 ELSE w.chunk END AS INT), CASE WHEN w.size + 1 + length(l.line) > 2200 THEN length(l.line) ELSE w.size + 1 + length(l.line) END FROM w JOIN lines l ON l.doc_id = w.doc_id AND l.ord = w.ord + 1)
SELECT doc_id, chunk, count(*) AS lines, max(size) AS n_chars FROM w GROUP BY doc_id, chunk HAVING max(size) >= 40""")
def w4_f43_greedy_chunks(spark, sf_dir):
    out = chunking.chunks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("n_chars"))


@query("""WITH c AS (SELECT source, length(text) AS n, contains(text, '|') AS has_table FROM documents) SELECT source, count(*) AS chunks, CAST(floor(avg(n)) AS BIGINT) AS mean_chars, count(*) FILTER (WHERE has_table) AS tables FROM c GROUP BY source""")
def a23_chunk_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.floor(F.avg(F.length("text"))).cast("long").alias("mean_chars"), F.count_if(c("text").contains("|")).alias("tables"))


_HEADED = f"{_LINES}, headed AS (SELECT doc_id, ord, CASE WHEN length(line) < 60 THEN 1 + length(line) % 3 END AS level, line AS title FROM lines)"


def _headed(spark, sf_dir):
    n = F.length("line")
    return chunking.lines(table(spark, sf_dir, "documents")).select("doc_id", "ord", F.when(n < 60, 1 + n % 3).alias("level"), F.col("line").alias("title"))


@query(f"""WITH {_HEADED}, a AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS h1, count(CASE WHEN level <= 1 THEN 1 END) OVER w AS g1, count(CASE WHEN level <= 2 THEN 1 END) OVER w AS g2 FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, g1 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS h2, last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, g2 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS h3 FROM a)
SELECT doc_id, CAST(ord AS INT) AS ord, CASE WHEN h1 IS NULL AND h2 IS NULL AND h3 IS NULL THEN '(front matter)' WHEN concat_ws(' > ', h1, h2, h3) = '' THEN '(front matter)' ELSE concat_ws(' > ', h1, h2, h3) END AS path FROM b""")
def w5_breadcrumbs(spark, sf_dir):
    return chunking.breadcrumbs(_headed(spark, sf_dir), "doc_id").select("doc_id", "ord", "path")


@query(f"WITH {_LINES}, p AS (SELECT doc_id, ord, CAST(floor(ord / 5.0) AS INT) + 1 AS page FROM lines), m AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM p) SELECT doc_id, CAST(ord AS INT) AS ord, page FROM m WHERE before IS NULL OR before <> page")
def w6_page_markers(spark, sf_dir):
    p = chunking.lines(table(spark, sf_dir, "documents")).select("doc_id", "ord", (F.floor(c("ord") / 5).cast("int") + 1).alias("page"))
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("ord"))
    return p.withColumn("before", before).where("before is null or before <> page").select("doc_id", "ord", "page")


@query(f"WITH {_LINES}, r AS (SELECT doc_id, 8 + length(line) % 4 AS size, sum(length(line)) AS chars FROM lines GROUP BY 1, 2) SELECT doc_id, CAST(size AS INT) AS body FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, size) = 1")
def a11_body_font(spark, sf_dir):
    runs = chunking.lines(table(spark, sf_dir, "documents")).select("doc_id", (8 + F.length("line") % 4).alias("size"), F.length("line").alias("chars"))
    return chunking.body_size(runs, "doc_id").select("doc_id", c("body").cast("int").alias("body"))


_PLACED = f"{_LINES}, m AS (SELECT doc_id, ord, CAST(floor(ord / 15.0) AS INT) AS page, (ord % 15 + 0.5) / 15 AS cy, length(line) % 100 / 100.0 AS cx, regexp_replace({_COLLAPSE.format('line')}, '[0-9]+', '#', 'g') AS k FROM lines)"


def placed_lines(spark, sf_dir):
    """Lines with the page they are on, their centre as shares of the page, and their key as a margin."""
    own = chunking.lines(table(spark, sf_dir, "documents"))
    return own.select("doc_id", "ord", F.floor(c("ord") / 15).cast("int").alias("page"), ((c("ord") % 15 + 0.5) / 15).alias("cy"), (F.length("line") % 100 / 100).alias("cx"), t.margin_key(c("line")).alias("k"))


@query(f"""WITH {_PLACED}, pages AS (SELECT doc_id, count(DISTINCT page) AS n FROM m GROUP BY doc_id),
rep AS (SELECT m.doc_id, k FROM m JOIN pages USING (doc_id) GROUP BY m.doc_id, k, n HAVING count(*) >= greatest(2, 0.2 * n)) SELECT doc_id, count(*) AS kept FROM m WHERE NOT ((cy < 0.07 OR cy > 0.93) AND EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = m.doc_id AND rep.k = m.k)) GROUP BY doc_id""")
def f42_margin_filter(spark, sf_dir):
    """Lines whose centre lies in the margin of a page, and whose text repeats over pages, go."""
    m = placed_lines(spark, sf_dir)
    rep = chunking.repeating_margins(m, "doc_id", "page", "k").withColumn("repeats", F.lit(True))
    margin = (c("cy") < chunking.MARGIN) | (c("cy") > 1 - chunking.MARGIN)
    kept = m.join(rep, ["doc_id", "k"], "left").where(~(margin & F.coalesce("repeats", F.lit(False))))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH {_PLACED}, tables AS (SELECT DISTINCT doc_id, page, n, 0.1 + 0.3 * n AS x0, 0.3 + 0.3 * n AS x1, 0.2 AS y0, 0.6 AS y1 FROM m, (SELECT unnest([0, 1]) AS n) WHERE page % 2 = 0)
SELECT m.doc_id, CAST(m.ord AS INT) AS ord FROM m WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.doc_id = m.doc_id AND t.page = m.page AND m.cx BETWEEN t.x0 AND t.x1 AND m.cy BETWEEN t.y0 AND t.y1)""")
def s8_lines_outside_tables(spark, sf_dir):
    """Lines of a page whose centre lies in none of its tables' boxes: tables come as units of their own."""
    m = placed_lines(spark, sf_dir)
    boxes = m.where("page % 2 = 0").select("doc_id", "page").distinct().withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    boxes = boxes.select("doc_id", "page", (0.1 + 0.3 * c("n")).alias("x0"), (0.3 + 0.3 * c("n")).alias("x1"), F.lit(0.2).alias("y0"), F.lit(0.6).alias("y1"))
    return chunking.outside(m, boxes, ["doc_id", "page"]).select("doc_id", "ord")


_SIZED = f"{_LINES}, sized AS (SELECT doc_id, ord, line, CAST(8 + length(line) % 7 AS INT) AS size FROM lines), bodies AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, sum(length(line)) AS chars FROM sized GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, size) = 1)"


def _sized(spark, sf_dir):
    lines = chunking.lines(table(spark, sf_dir, "documents")).withColumn("size", (8 + F.length("line") % 7).cast("int"))
    return lines, chunking.body_size(lines.withColumn("chars", F.length("line")), "doc_id")


@query(f"""WITH {_SIZED}, ranks AS (SELECT s.doc_id, s.size, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.size DESC) AS level FROM (SELECT DISTINCT doc_id, size FROM sized) s JOIN bodies USING (doc_id) WHERE s.size >= body + 1)
SELECT s.doc_id, CAST(s.ord AS INT) AS ord, CAST(level AS INT) AS level FROM sized s JOIN ranks USING (doc_id, size) WHERE level <= 3 AND length(line) < 90 AND NOT regexp_matches(rtrim(line), '[.,]$')""")
def f41_sized_headings(spark, sf_dir):
    lines, body = _sized(spark, sf_dir)
    return chunking.sized_headings(lines, body).where("level is not null").select("doc_id", "ord", "level")


@query()
def f41_listed_headings(spark, sf_dir):
    """Headings by a table of contents: every third line, numbered, is an entry, some broken over two lines, some of other pages."""
    lines = chunking.lines(table(spark, sf_dir, "documents")).withColumn("page", F.floor(c("ord") / 6).cast("int"))
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("ord"))
    title = F.when(c("ord") % 9 == 0, F.concat_ws(" ", "line", after)).when(c("ord") % 15 == 3, F.lit("not on the page")).otherwise(F.substring("line", 1, 30))
    entries = lines.select("doc_id", "page", "ord", "line", title.alias("t")).where("ord % 3 = 0").select("doc_id", "page", c("ord").alias("at"), (1 + c("ord") % 6).alias("level"), F.concat(c("ord") + 1, F.lit(".2 "), "t").alias("title"))
    return chunking.listed_headings(lines, entries)


def units(spark, sf_dir):
    """Units of documents: headed sections, runs of lines with a bar are tables, others paragraphs; five lines are a page."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    n, size = F.length("line"), F.length(F.trim("line"))
    level = F.when((n < 60) & (n % 4 > 0), n % 4)
    own = chunking.lines(table(spark, sf_dir, "documents")).withColumns({"level": level, "title": F.when(c("ord") % 11 == 5, "Contents").otherwise(c("line")), "page": F.floor(c("ord") / 5).cast("int") + 1})
    own = chunking.breadcrumbs(own, "doc_id")
    own = own.withColumns({"section": F.count("level").over(w), "kind": F.when(c("line").contains("|"), "table").otherwise("text")}).where("level is null").where(size > 0)
    starts = (F.coalesce(F.lag("kind").over(Window.partitionBy("doc_id", "section").orderBy("ord")), F.lit("")) != c("kind")) | (c("kind") == "text")
    own = own.withColumn("unit", F.sum(starts.cast("int")).over(Window.partitionBy("doc_id", "section").orderBy("ord")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return own.groupBy("doc_id", "section", "path", "kind", "unit").agg(F.min("ord").alias("ord"), F.min("page").alias("page"), line.alias("text")).withColumn("top", F.substring_index("path", " > ", 1)).drop("unit")


@query()
def f43_f35_section_chunks(spark, sf_dir):
    """Order-dependent gathering of units; tests hold it against a plain version."""
    out = chunking.section_chunks(units(spark, sf_dir))
    return out.select("doc_id", "section", "chunk", "path", "page_start", "page_end", "kind", F.length("text").alias("n_chars"))


@query()
def f28_paragraphs(spark, sf_dir):
    """Order-dependent repair of lines, in Arrow batches; tested against plain cases."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(chunking.paragraphs("text")).alias("n_chars"))
