"""Schemas of the engine's tables. Every geometric row carries its page (doc_id, page_number) and seq, its place in the
page's emission order; coordinates are doubles, top-left based next to the raw bottom-left y0 and y1."""

BOX = "STRUCT<x0:DOUBLE,top:DOUBLE,x1:DOUBLE,bottom:DOUBLE>"
POINT = "STRUCT<x:DOUBLE,y:DOUBLE>"
COLOR = "STRUCT<scalar:BOOLEAN,components:ARRAY<DOUBLE>,pattern:STRING>"
GEOM = "doc_id LONG, page_number INT, seq INT, object_type STRING, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE, top DOUBLE, bottom DOUBLE, doctop DOUBLE, width DOUBLE, height DOUBLE"
CHARS = f"{GEOM}, text STRING, fontname STRING, size DOUBLE, adv DOUBLE, upright BOOLEAN, matrix ARRAY<DOUBLE>, ncs STRING, non_stroking_color {COLOR}, stroking_color {COLOR}, mcid INT, tag STRING"
VECTORS = f"{GEOM}, pts ARRAY<{POINT}>, path ARRAY<STRUCT<cmd:STRING,pts:ARRAY<{POINT}>>>, closepath BOOLEAN, linewidth DOUBLE, dash STRUCT<pattern:ARRAY<STRING>,phase:DOUBLE>, fill BOOLEAN, stroke BOOLEAN, evenodd BOOLEAN, stroking_color {COLOR}, non_stroking_color {COLOR}, mcid INT, tag STRING"
IMAGES = f"{GEOM}, name STRING, srcsize ARRAY<DOUBLE>, colorspace STRING, bits INT, imagemask BOOLEAN, mcid INT, tag STRING"
ANNOTS = f"{GEOM}, uri STRING, title STRING, contents STRING, data STRING"
PAGES = f"doc_id LONG, page_number INT, label STRING, width DOUBLE, height DOUBLE, rotate INT, bbox {BOX}, mediabox {BOX}, cropbox {BOX}, artbox {BOX}, bleedbox {BOX}, trimbox {BOX}, doctop_offset DOUBLE, annots_error STRING, error STRING"
DOCUMENTS = "doc_id LONG, path STRING, page_count INT, metadata MAP<STRING,STRING>, error STRUCT<name:STRING,message:STRING>"
PAGE = ["doc_id", "page_number"]
