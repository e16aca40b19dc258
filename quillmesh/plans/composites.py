"""The queries a user asks: nested tags, assigned devices, what a photo shows, answers, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions import text as t
from quillmesh.operators import order, spatial
from quillmesh.plans import inputs as i
from quillmesh.plans.registry import query, table
from quillmesh.plans.spatial import _EXPECTED_BOXES, _NEAREST, _VISIBLE, f13_f14_expected_boxes, visible
from quillmesh.sinks import render
from quillmesh.streaming import evidence

c = F.col


def devices(spark, sf_dir):
    """Detections of device classes with the cabinet they are at and what has to be looked at again."""
    near = spatial.nearest(i.detections(spark, sf_dir).where(c("class") != "error"), i.cabinets(spark, sf_dir), "id")
    far = F.format_string("nearest cabinet %d is %.1f m away (limit 1.5 m)", "near", "dist")
    reasons = F.filter(F.array(F.when(c("x").isNull(), "no position"), F.when(c("x").isNotNull() & c("near").isNull(), "no cabinet positions loaded"), F.when(c("dist") > 1.5, far)), lambda r: r.isNotNull())
    return near.select("id", "class", "conf", F.when(c("dist") <= 1.5, c("near")).alias("tag_id"), reasons.alias("reasons"))


_DEVICES = f"""{i.CABINETS}, {i.DETECTIONS}, {_NEAREST}, devices AS (SELECT id, class, conf, CASE WHEN dist <= 1.5 THEN near END AS tag_id,
concat_ws('; ', CASE WHEN dx IS NULL THEN 'no position' END, CASE WHEN dist > 1.5 THEN 'nearest cabinet ' || near || ' is ' || format('{{:.1f}}', dist) || ' m away (limit 1.5 m)' END) AS reasons FROM nearest WHERE class <> 'error')"""


@query(f"WITH {_DEVICES} SELECT id, tag_id, reasons <> '' AS needs_review, length(reasons) AS reason_chars FROM devices")
def api_detections(spark, sf_dir):
    reasons = F.array_join("reasons", "; ")
    return devices(spark, sf_dir).select("id", "tag_id", (F.size("reasons") > 0).alias("needs_review"), F.length(reasons).cast("long").alias("reason_chars"))


@query(f"WITH {_DEVICES} SELECT id FROM devices WHERE tag_id IS NULL")
def api_unassigned_devices(spark, sf_dir):
    return devices(spark, sf_dir).where("tag_id is null").select("id")


@query(f"WITH {_DEVICES}, n AS (SELECT tag_id, count(*) AS n, string_agg(class || ':' || id, ' ' ORDER BY id) AS devices FROM devices WHERE tag_id IS NOT NULL GROUP BY tag_id) SELECT c.id, c.name, x IS NOT NULL AS placed, coalesce(n, 0) AS n, coalesce(devices, '') AS devices FROM cabinets c LEFT JOIN n ON c.id = n.tag_id")
def api_tags(spark, sf_dir):
    """Tags with their devices nested: one join instead of a query for each tag."""
    inner = devices(spark, sf_dir).where("tag_id is not null").groupBy("tag_id").agg(F.sort_array(F.collect_list(F.struct("id", "class"))).alias("devices"))
    out = i.cabinets(spark, sf_dir).join(inner, c("id") == c("tag_id"), "left")
    return out.select("id", "name", c("x").isNotNull().alias("placed"), F.coalesce(F.size("devices"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("devices", lambda d: F.concat_ws(":", d["class"], d["id"])), " "), F.lit("")).alias("devices"))


@query(f"""WITH {_VISIBLE}, {_EXPECTED_BOXES}, d AS (SELECT user_id % 10 AS cam, event_id % 25 AS cab, count(*) AS n FROM events GROUP BY 1, 2)
SELECT ok.camera_id, ok.id AS cabinet, round(ok.depth, 3) AS depth, coalesce(d.n, 0) AS detected, e.x0, e.y0, e.x1, e.y1, e.visible, count(*) OVER (PARTITION BY ok.camera_id) AS in_view
FROM ok LEFT JOIN d ON d.cam = ok.camera_id AND d.cab = ok.id LEFT JOIN expected_boxes e ON e.camera_id = ok.camera_id AND e.cabinet = ok.id""")
def api_locate(spark, sf_dir):
    """Cabinets in view of each photo, where their front must appear, and how many detections the photo has of each."""
    seen = table(spark, sf_dir, "events").groupBy((c("user_id") % 10).alias("cam"), (c("event_id") % 25).alias("cab")).agg(F.count(F.lit(1)).alias("n"))
    out = visible(spark, sf_dir).select("camera_id", c("id").alias("cabinet"), F.round("px.depth", 3).alias("depth"))
    out = out.join(seen, (c("cam") == c("camera_id")) & (c("cab") == c("cabinet")), "left").join(f13_f14_expected_boxes(spark, sf_dir), ["camera_id", "cabinet"], "left")
    in_view = F.count(F.lit(1)).over(Window.partitionBy("camera_id"))
    return out.select("camera_id", "cabinet", "depth", F.coalesce("n", F.lit(0)).alias("detected"), "x0", "y0", "x1", "y1", "visible", in_view.alias("in_view"))


_DOCS = "docs AS (SELECT o_custkey % 25 AS tag, string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus) AS documents FROM orders GROUP BY 1)"


def sheet(spark, sf_dir):
    """Rows of the manual tagging sheet, numbered in the order of ids."""
    docs = table(spark, sf_dir, "orders").groupBy((c("o_custkey") % 25).alias("tag")).agg(F.sort_array(F.collect_set("o_orderstatus")).alias("documents"))
    kinds = devices(spark, sf_dir).where("tag_id is not null").groupBy("tag_id").agg(F.sort_array(F.collect_set("class")).alias("devices"))
    out = i.cabinets(spark, sf_dir).join(docs, c("id") == c("tag"), "left").join(kinds, c("id") == c("tag_id"), "left")
    return order.placed(out, ["id"], "n").select("n", "id", "name", "folder", "x", "y", "z", "devices", "documents", F.coalesce(c("confidence") < 0.25, F.lit(False)).alias("needs_review"))


@query(f"""WITH {_DEVICES}, {_DOCS}, k AS (SELECT tag_id, string_agg(DISTINCT class, '; ' ORDER BY class) AS devices FROM devices WHERE tag_id IS NOT NULL GROUP BY tag_id)
SELECT row_number() OVER (ORDER BY c.id) || ',' || name || ',' || folder || ',' || coalesce(devices, '') || ',' || coalesce(documents, '') || ',' || coalesce(confidence < 0.25, false) AS line FROM cabinets c LEFT JOIN docs ON c.id = docs.tag LEFT JOIN k ON c.id = k.tag_id""")
def export_manual_sheet(spark, sf_dir):
    rows = sheet(spark, sf_dir)
    lists = rows.withColumns({"devices": F.coalesce(F.array_join("devices", "; "), F.lit("")), "documents": F.coalesce(F.array_join("documents", " | "), F.lit(""))})
    return render.csv(lists, ["n", "name", "folder", "devices", "documents", "needs_review"])


@query(f"""WITH {i.CABINETS}, {_DOCS} SELECT id, CASE WHEN x IS NULL THEN 'no position yet' END AS skipped, CASE WHEN x IS NULL THEN NULL WHEN id % 6 = 5 THEN 0.0 WHEN x < -4 THEN 1.0 ELSE -1.0 END AS normal_x, CASE WHEN x IS NULL THEN NULL WHEN id % 6 = 5 THEN 1.0 ELSE 0.0 END AS normal_z, CASE WHEN x IS NOT NULL THEN 0.4 END AS stem_length,
CASE WHEN x IS NOT NULL THEN coalesce(CASE WHEN documents IS NULL OR documents = '' THEN NULL ELSE 'Documents: ' || documents END, name) END AS description, CASE WHEN x IS NOT NULL THEN split_part(documents, ' | ', 1) END AS media FROM cabinets LEFT JOIN docs ON id = tag""")
def export_twin_tags(spark, sf_dir):
    """Tags for a viewer; those without a position are listed as skipped instead."""
    from quillmesh.functions import geometry as g

    rows, placed = sheet(spark, sf_dir), c("x").isNotNull()
    # a cabinet that no geometry is known of has its stem upright
    normal = F.when(placed, F.when(c("id") % 6 == 5, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(g.door_normal(c("x"))))
    joined = F.array_join("documents", " | ")
    text = F.coalesce(F.nullif(t.description(F.when(F.size("documents") > 0, F.concat(F.lit("Documents: "), joined))), F.lit("")), c("name"))
    return rows.select("id", F.when(~placed, "no position yet").alias("skipped"), normal[0].alias("normal_x"), normal[2].alias("normal_z"), F.when(placed, F.lit(0.4)).alias("stem_length"), F.when(placed, text).alias("description"), F.when(placed, F.try_element_at("documents", F.lit(1))).alias("media"))


@query(f"WITH {i.CABINETS} SELECT (SELECT count(*) FROM cabinets) AS tags, (SELECT count(*) FROM cabinets WHERE x IS NOT NULL) AS found, (SELECT string_agg(name, ' ' ORDER BY name) FROM cabinets WHERE x IS NULL) AS missing")
def api_methods(spark, sf_dir):
    return i.cabinets(spark, sf_dir).agg(F.count(F.lit(1)).alias("tags"), F.count("x").alias("found"), F.array_join(F.sort_array(F.collect_list(F.when(c("x").isNull(), c("name")))), " ").alias("missing"))


@query(f"""WITH {i.CABINETS}, {i.DETECTIONS}, {_NEAREST}, b AS (SELECT near, max(conf) AS conf FROM nearest WHERE class = 'error' AND conf >= 0.25 AND dist <= 0.6 GROUP BY near)
SELECT id, CASE WHEN b.near IS NULL THEN confidence ELSE greatest(conf, coalesce(confidence, 0)) END AS confidence, folder || CASE WHEN b.near IS NULL THEN '' ELSE ' panel' END AS models FROM cabinets LEFT JOIN b ON b.near = id""")
def stream_evidence_fold(spark, sf_dir):
    """A batch of what the stream does; tests run the stream itself against it."""
    cab = i.cabinets(spark, sf_dir).withColumn("models", F.array("folder"))
    out = evidence.fold(cab, i.detections(spark, sf_dir), "error", "panel")
    return out.select("id", "confidence", F.array_join("models", " ").alias("models"))
