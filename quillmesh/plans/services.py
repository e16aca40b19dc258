"""What the service answers: imports and their counts, nested documents, questions to the manuals.

Manuals are suppliers, of seven models; a cabinet has one or two models, and its devices have those of their class.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import fulltext, merge, spatial
from quillmesh.plans import composites, inputs as i
from quillmesh.plans.composites import _DEVICES
from quillmesh.plans.registry import query, table
from quillmesh.plans.spatial import _LABELS, _NEAREST, _PAIRS, RADIUS

c = F.col

# ---- documents

_MANUALS = """manuals AS (SELECT s_suppkey AS doc, s_name AS title, 'M' || (s_suppkey % 7) AS model, s_suppkey % 40 AS pages FROM supplier),
models AS (SELECT id, 'M' || (id % 7) AS model FROM cabinets UNION SELECT id, 'M6' FROM cabinets WHERE id % 3 = 0),
kinds AS (SELECT * FROM (VALUES ('click', 'relay', 'M1'), ('view', 'meter', 'M2'), ('purchase', 'breaker', 'M3')) k(class, type, model))"""
KINDS = [("click", "relay", "M1"), ("view", "meter", "M2"), ("purchase", "breaker", "M3")]


def manuals(spark, sf_dir):
    k = c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("doc"), c("s_name").alias("title"), F.concat(F.lit("M"), k % 7).alias("model"), (k % 40).alias("pages"))


def tag_models(spark, sf_dir):
    own = F.array_compact(F.array(F.concat(F.lit("M"), c("id") % 7), F.when(c("id") % 3 == 0, F.lit("M6"))))
    return i.cabinets(spark, sf_dir).select("id", F.explode(F.array_distinct(own)).alias("model"))


def kinds(spark):
    return spark.createDataFrame(KINDS, "class string, type string, model string")


@query(f"WITH {i.CABINETS}, {_MANUALS} SELECT doc, title, model, pages, '/documents/' || doc || '/file' AS url FROM manuals WHERE model = 'M3'")
def api_documents_of_model(spark, sf_dir):
    return documents(manuals(spark, sf_dir), "M3")


def documents(manuals_, model=None):
    """All documents, or those of one model, with their links."""
    own = manuals_ if not model else manuals_.where(c("model") == model)
    return own.select("doc", "title", "model", "pages", F.concat(F.lit("/documents/"), "doc", F.lit("/file")).alias("url"))


@query(f"""WITH {_DEVICES}, {_MANUALS}, own AS (SELECT id, 0 AS list, doc FROM models JOIN manuals USING (model) UNION ALL SELECT d.tag_id, 1, doc FROM (SELECT DISTINCT tag_id, class FROM devices WHERE tag_id IS NOT NULL) d JOIN kinds USING (class) JOIN manuals USING (model)),
seen AS (SELECT id, doc, min(list) AS list FROM own GROUP BY id, doc), n AS (SELECT id, count(*) FILTER (WHERE list = 0) AS own_documents, count(*) AS documents, string_agg(CAST(doc AS VARCHAR), ' ' ORDER BY list, doc) AS docs FROM seen GROUP BY id)
SELECT c.id, coalesce(own_documents, 0) AS own_documents, coalesce(documents, 0) AS documents, coalesce(docs, '') AS docs FROM cabinets c LEFT JOIN n ON c.id = n.id""")
def api_tag_documents(spark, sf_dir):
    """The documents of each tag, then those of its devices that are not among them."""
    docs = manuals(spark, sf_dir)
    own = tag_models(spark, sf_dir).join(docs, "model").select("id", F.lit(0).alias("list"), "doc")
    below = composites.devices(spark, sf_dir).where("tag_id is not null").select("tag_id", "class").distinct().join(F.broadcast(kinds(spark)), "class").join(docs, "model").select(c("tag_id").alias("id"), F.lit(1).alias("list"), "doc")
    seen = own.unionByName(below).groupBy("id", "doc").agg(F.min("list").alias("list"))
    each = seen.groupBy("id").agg(F.count_if(c("list") == 0).alias("own_documents"), F.count(F.lit(1)).alias("documents"), F.sort_array(F.collect_list(F.struct("list", "doc"))).alias("d"))
    out = i.cabinets(spark, sf_dir).select("id").join(each, "id", "left")
    text = F.array_join(F.transform("d", lambda x: x["doc"].cast("string")), " ")
    return out.select("id", F.coalesce("own_documents", F.lit(0)).alias("own_documents"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(text, F.lit("")).alias("docs"))


@query(f"WITH {i.CABINETS}, asked AS (SELECT unnest([3, 99, 7]) AS asked) SELECT asked, name, id IS NOT NULL AS found FROM asked LEFT JOIN cabinets ON id = asked")
def api_one_tag(spark, sf_dir):
    """Tags that are asked for by id; an unknown one is told apart from an empty one."""
    asked = spark.createDataFrame([(3,), (99,), (7,)], "asked int")
    return asked.join(i.cabinets(spark, sf_dir), c("asked") == c("id"), "left").select("asked", "name", c("id").isNotNull().alias("found"))


@query(f"WITH {_DEVICES}, {_MANUALS} SELECT (SELECT count(*) FROM cabinets) AS tags, (SELECT count(*) FROM cabinets WHERE x IS NOT NULL) AS placed, (SELECT count(*) FROM devices) AS devices, (SELECT count(*) FROM manuals) AS documents, true AS knowledge")
def api_health(spark, sf_dir):
    tags = i.cabinets(spark, sf_dir).agg(F.count(F.lit(1)).alias("tags"), F.count("x").alias("placed"))
    devices = i.detections(spark, sf_dir).agg(F.count_if(c("class") != "error").alias("devices"))
    docs = manuals(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"))
    return tags.join(devices, how="cross").join(docs, how="cross").withColumn("knowledge", c("documents") > 0)


# ---- imports

_ITEMS = "items AS (SELECT n_nationkey + 10 AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'item ' || n_nationkey END AS name, n_nationkey + 0.5 AS x, CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_nationkey % 7 AS DOUBLE) / 10 END AS confidence FROM nation)"


def _imported(spark, sf_dir):
    k = c("n_nationkey")
    items = table(spark, sf_dir, "nation").select((k + 10).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("item "), k)).alias("name"), (k + F.lit(0.5)).cast("double").alias("x"), F.when(k % 4 > 0, k % 7 / 10).alias("confidence"), k.alias("seq"))
    return merge.import_tags(i.cabinets(spark, sf_dir).select("id", "name", "x", "confidence"), items, "seq")


@query(f"""WITH {i.CABINETS}, {_ITEMS} SELECT coalesce(c.id, t.id) AS id, coalesce(c.name, t.name, CAST(t.id AS VARCHAR)) AS name, CASE WHEN t.id IS NULL THEN c.x ELSE t.x END AS x, CASE WHEN t.id IS NULL THEN c.confidence ELSE t.confidence END AS confidence,
CASE WHEN t.id IS NOT NULL THEN coalesce(t.confidence < 0.25, false) END AS needs_review, t.id IS NOT NULL AS found, CASE WHEN c.id IS NULL THEN 'import' END AS created_by FROM cabinets c FULL JOIN items t ON c.id = t.id""")
def api_import_cabinets(spark, sf_dir):
    """Positions and confidences of known cabinets are replaced, their names kept; unknown ones are added."""
    return _imported(spark, sf_dir)


@query(f"WITH {i.CABINETS}, {_ITEMS} SELECT count(*) FILTER (WHERE c.id IS NOT NULL) AS updated, count(*) FILTER (WHERE c.id IS NULL) AS added FROM items t LEFT JOIN cabinets c ON c.id = t.id")
def api_import_counts(spark, sf_dir):
    return _imported(spark, sf_dir).where("found").agg(F.count_if(c("created_by").isNull()).alias("updated"), F.count_if(c("created_by").isNotNull()).alias("added"))


_PHYSICAL = f"""{i.SIGHTINGS}, {_PAIRS}, {_LABELS}, phys AS (SELECT label, kind, cluster, sum(confidence*x)/sum(confidence) AS x, sum(confidence*y)/sum(confidence) AS y, sum(confidence*z)/sum(confidence) AS z, max(confidence) AS confidence, count(*) AS observations FROM sightings JOIN labels ON node = tag_id GROUP BY label, kind, cluster),
cub AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cluster DESC) AS back FROM phys WHERE kind = 'K0'), known AS (SELECT 'L' || (n_nationkey * 3) AS label FROM nation WHERE n_nationkey < 2),
tags AS (SELECT label AS id, x, y, z, confidence, observations, label IN (SELECT label FROM known) AS known FROM cub WHERE back = 1),
near AS (SELECT p.label, p.kind, p.cluster, t.id AS near, sqrt((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)+(p.z-t.z)*(p.z-t.z)) AS dist FROM phys p LEFT JOIN tags t ON true WHERE p.kind <> 'K0' QUALIFY row_number() OVER (PARTITION BY p.label, p.kind, p.cluster ORDER BY dist, t.id) = 1)"""
REACH = 0.3


def _processed(spark, sf_dir):
    """(tags after a run, devices of the run, physical tags): cubicles first, the last of a label wins; then equipment at the nearest."""
    own = spatial.physical_tags(spatial.clusters(i.sightings(spark, sf_dir), RADIUS, ["label", "kind"]), ["label", "kind"])
    cub = own.where("kind = 'K0'")
    tags = merge.latest(cub.select(c("label").alias("id"), "cluster", "x", "y", "z", "confidence", "observations"), "id", "cluster")
    equipment = own.where("kind <> 'K0'").select(F.concat_ws("/", "label", "cluster").alias("device"), "label", "cluster", "x", "y", "z", "confidence")
    near = spatial.nearest(equipment, tags, "device")
    return tags, near, own


@query(f"WITH RECURSIVE {_PHYSICAL} SELECT id, round(x, 4) AS x, round(confidence, 4) AS confidence, observations, known FROM tags")
def api_process_tags(spark, sf_dir):
    tags, _, _ = _processed(spark, sf_dir)
    known = table(spark, sf_dir, "nation").where("n_nationkey < 2").select(F.concat(F.lit("L"), c("n_nationkey") * 3).alias("id"), F.lit(True).alias("known"))
    return tags.join(known, "id", "left").select("id", F.round("x", 4).alias("x"), F.round("confidence", 4).alias("confidence"), "observations", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH RECURSIVE {_PHYSICAL} SELECT label, cluster, CASE WHEN dist <= {REACH} THEN near END AS tag_id, 'Unknown' AS type, label AS model FROM near")
def api_process_devices(spark, sf_dir):
    """Equipment of classes that no table knows keeps its label as its model."""
    _, near, _ = _processed(spark, sf_dir)
    out = near.join(F.broadcast(kinds(spark)), c("label") == c("class"), "left")
    return out.select("label", "cluster", F.when(c("dist") <= REACH, c("near")).alias("tag_id"), F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("model", "label").alias("model"))


@query(f"""WITH RECURSIVE {_PHYSICAL} SELECT (SELECT count(*) FROM phys) AS physical_tags_found, (SELECT count(*) FROM cub) - (SELECT count(*) FROM tags WHERE NOT known) AS cabinets_updated, (SELECT count(*) FROM tags WHERE NOT known) AS cabinets_added, (SELECT count(*) FROM near) AS devices_added""")
def api_process_counts(spark, sf_dir):
    """Every cubicle but the first of an unknown label updates a tag."""
    _, _, own = _processed(spark, sf_dir)
    known = F.col("label").isin("L0", "L3")
    cubicle = c("kind") == "K0"
    n = own.agg(F.count(F.lit(1)).alias("physical_tags_found"), F.count_if(cubicle).alias("cubicles"), F.countDistinct(F.when(cubicle & ~known, c("label"))).alias("cabinets_added"), F.count_if(~cubicle).alias("devices_added"))
    return n.select("physical_tags_found", (c("cubicles") - c("cabinets_added")).alias("cabinets_updated"), "cabinets_added", "devices_added")


# ---- detections

_ROUTED = f"""{i.CABINETS}, {i.DETECTIONS}, {_NEAREST}, routed AS (SELECT *, CASE WHEN class = 'error' THEN 'panel' WHEN class NOT IN ('click', 'view', 'purchase') OR conf < 0.25 THEN 'ignored' ELSE 'created' END AS route FROM nearest)"""


def routed(spark, sf_dir):
    near = spatial.nearest(i.detections(spark, sf_dir), i.cabinets(spark, sf_dir), "id")
    device = c("class").isin("click", "view", "purchase")
    return near.withColumn("route", F.when(c("class") == "error", "panel").when(~device | (c("conf") < 0.25), "ignored").otherwise("created"))


@query(f"""WITH {_ROUTED} SELECT count(*) FILTER (WHERE route = 'created') AS created, count(*) FILTER (WHERE route = 'created' AND (dx IS NULL OR dist > 1.5)) AS to_review, count(*) FILTER (WHERE route = 'ignored') AS ignored,
count(*) FILTER (WHERE route = 'panel' AND dist <= 0.6 AND conf >= 0.25) AS panels_applied, count(*) FILTER (WHERE route = 'panel' AND NOT coalesce(dist <= 0.6 AND conf >= 0.25, false)) AS panels_refused FROM routed""")
def api_detection_counts(spark, sf_dir):
    own, applied = routed(spark, sf_dir), F.coalesce((c("dist") <= 0.6) & (c("conf") >= 0.25), F.lit(False))
    panel, created = c("route") == "panel", c("route") == "created"
    return own.agg(F.count_if(created).alias("created"), F.count_if(created & (c("x").isNull() | (c("dist") > 1.5))).alias("to_review"), F.count_if(c("route") == "ignored").alias("ignored"), F.count_if(panel & applied).alias("panels_applied"), F.count_if(panel & ~applied).alias("panels_refused"))


@query(f"""WITH {_ROUTED} SELECT id, CASE WHEN dist <= 0.6 AND conf >= 0.25 THEN near END AS cabinet, coalesce(dist <= 0.6 AND conf >= 0.25, false) AS applied,
CASE WHEN dx IS NULL THEN 'no position' WHEN near IS NULL THEN 'no cabinet positions loaded' WHEN dist > 0.6 THEN 'nearest cabinet ' || near || ' is ' || format('{{:.2f}}', dist) || ' m away (limit 0.6 m)' WHEN conf < 0.25 THEN 'confidence ' || format('{{:.2f}}', conf) || ' below 0.25' ELSE 'panel detected at this cabinet' END AS reason FROM routed WHERE route = 'panel'""")
def api_panel_evidence(spark, sf_dir):
    own = routed(spark, sf_dir).where("route = 'panel'")
    why = F.when(c("x").isNull(), "no position").when(c("near").isNull(), "no cabinet positions loaded").when(c("dist") > 0.6, F.format_string("nearest cabinet %d is %.2f m away (limit 0.6 m)", "near", "dist"))
    why = why.when(c("conf") < 0.25, F.format_string("confidence %.2f below 0.25", "conf")).otherwise("panel detected at this cabinet")
    applied = F.coalesce((c("dist") <= 0.6) & (c("conf") >= 0.25), F.lit(False))
    return own.select("id", F.when(applied, c("near")).alias("cabinet"), applied.alias("applied"), why.alias("reason"))


# ---- questions


@query()
def f37_stemmed_search(spark, sf_dir):
    """Ranked search on stems; tests hold it against a plain version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("section"))
    return fulltext.search(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 3, stemmed=True).select("question", "place", "chunk", F.round("score", 4).alias("score"))


@query()
def api_ask(spark, sf_dir):
    """Questions at a tag: passages of the documents of its models and its devices' models, with links; or why there are none.

    A chunk is a document of the table, its language is its model; a tag whose models have no document has no answer.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", c("doc_id").alias("document"), "text", F.substring_index("text", "\n", 1).alias("section"), c("lang").alias("model"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text", (c("item_id") % 25).alias("tag"))
    languages = spark.createDataFrame([("M0", "en"), ("M1", "de"), ("M2", "fr"), ("M3", "es")], "model string, lang string")
    below = composites.devices(spark, sf_dir).where("tag_id is not null").select(c("tag_id").alias("id"), "class").distinct().join(F.broadcast(kinds(spark)), "class").select("id", "model")
    models = tag_models(spark, sf_dir).where("id % 2 = 0").unionByName(below.where("id % 5 > 0")).distinct().join(F.broadcast(languages), "model").select(c("id").alias("tag"), "lang").distinct()
    of_tag = asked.join(models, "tag").select(c("item_id").alias("question"), "lang")
    allowed = of_tag.select("question", c("lang").alias("model"))
    found = fulltext.search(docs, asked, "doc_id", "item_id", 5, stemmed=True, allowed=allowed)
    passages = found.join(docs.select(c("doc_id").alias("chunk"), "document", "model", "section", "text"), "chunk")
    link = F.concat(F.lit("/documents/"), "document", F.lit("/file#page=1"))
    passages = passages.select("question", "place", "document", "model", link.alias("link"), F.substring("text", 1, 1200).alias("passage"))
    out = asked.join(passages, c("item_id") == c("question"), "left").join(of_tag.select(c("question").alias("_with")).distinct(), c("item_id") == c("_with"), "left")
    note = F.when(c("_with").isNull(), F.format_string("tag %d has no documents", "tag")).when(c("place").isNull(), "not found in the manuals")
    return out.select(c("item_id").alias("question"), "tag", c("place").isNotNull().alias("found"), "place", "document", "model", "link", "passage", note.alias("note"))
