"""Readers: every input format as frames with explicit schemas; missing fields take the format's defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions.text import DOC_ROLES, role_of, words

PAGE_HEIGHT = 792.0
BBOX = "array<float>"
QDOC = f"format string, pages array<struct<page:int,width:float,height:float,spans:array<struct<text:string,bbox:{BBOX},confidence:float,rotated:boolean>>,table_regions:array<struct<bbox:{BBOX},note:string,figure_score:float>>>>"
TRUTH = f"tables array<struct<name:string,page:int,bbox:{BBOX},cells:array<array<string>>,column_types:array<string>,difficulty:string>>"
_PROV = "prov:array<struct<page_no:int,bbox:struct<l:float,t:float,r:float,b:float,coord_origin:string>>>"
_REF = "array<struct<`$ref`:string>>"
DOCLING = (
    "pages map<string,struct<size:struct<width:float,height:float>>>, "
    f"tables array<struct<{_PROV},data:struct<num_rows:int,num_cols:int,table_cells:array<struct<bbox:struct<l:float,t:float,r:float,b:float,coord_origin:string>,text:string,start_row_offset_idx:int,start_col_offset_idx:int,column_header:boolean>>>>>, "
    f"texts array<struct<label:string,text:string,{_PROV}>>, groups array<struct<children:{_REF}>>, pictures array<struct<{_PROV},children:{_REF}>>, body struct<children:{_REF}>"
)
LITEPARSE_REGION = "text string, words array<struct<text:string,x0:float,y0:float,x1:float,y1:float>>"
LITEPARSE_DOC = "pages array<struct<page:int,width:float,height:float,textItems:array<struct<text:string,x:float,y:float,width:float,height:float,confidence:float>>>>"
LAYOUT = f"regions array<struct<label:string,confidence:float,bbox:{BBOX}>>, scale float"
CLOUD = f"tables array<struct<page:int,bbox:{BBOX},n_rows:int,n_cols:int,cells:array<struct<row:int,col:int,text:string,bbox:{BBOX},is_header:boolean>>>>"
TRIAGE = "page int, width float, height float, chars long, stddev double, klass string"
WORDS = "text string, x0 float, y0 float, x1 float, y1 float"
JUDGE = (
    f"id string, grid array<array<string>>, header_rows int, source string, page int, cell_boxes array<array<{BBOX}>>, source_words array<struct<text:string,bbox:{BBOX}>>, "
    f"region {BBOX}, alt_grid array<array<string>>, alt_header_rows int, alt_cell_boxes array<array<{BBOX}>>, alt_page int"
)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents (one per file) with the file's path; a malformed one is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.input_file_name())


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc (SHA-256 of the bytes), path and content of every matching file below path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select(F.sha2("content", 256).alias("doc"), "path", "content")


def text_layers(spark: SparkSession, path: str, glob: str = "*") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, spans and table regions of text-layer files. A file that is no such JSON gives a document without pages."""
    docs = files(spark, path, glob).withColumn("d", F.from_json(F.decode("content", "utf-8"), QDOC)).select("doc", "path", "d")
    pages = docs.select("doc", F.explode_outer("d.pages").alias("p"), F.coalesce("d.format", F.lit("opaque")).alias("format"))
    frame = pages.select("doc", "format", "p.page", "p.width", "p.height").where("page IS NOT NULL")
    return frame, spans_of(pages), regions_of(pages)


def extent_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, width and height for every page an extractor is to be run on: a document without pages has one, of letter size."""
    letter = (F.lit(1).alias("page"), F.lit(612.0).cast("float").alias("width"), F.lit(PAGE_HEIGHT).cast("float").alias("height"))
    bare = docs.select("doc").distinct().join(pages.select("doc").distinct(), "doc", "left_anti")
    return pages.select("doc", "page", "width", "height").unionByName(bare.select("doc", *letter))


def spans_of(pages: DataFrame) -> DataFrame:
    """doc, page, ord, text, bbox, confidence and rotated from rows of (doc, p)."""
    each = pages.select("doc", "p.page", F.posexplode("p.spans").alias("ord", "s"))
    return each.select("doc", "page", "ord", "s.text", G.box_of(F.col("s.bbox")).alias("bbox"), F.coalesce("s.confidence", F.lit(1.0).cast("float")).alias("confidence"), F.coalesce("s.rotated", F.lit(False)).alias("rotated"))


def regions_of(pages: DataFrame) -> DataFrame:
    each = pages.select("doc", "p.page", F.posexplode("p.table_regions").alias("ord", "r"))
    return each.select("doc", "page", "ord", G.box_of(F.col("r.bbox")).alias("bbox"), "r.note", F.coalesce("r.figure_score", F.lit(0.0).cast("float")).alias("figure_score"))


def page_lookup(pages: DataFrame) -> DataFrame:
    """The first page of each number."""
    return pages.groupBy("doc", "page").agg(F.min_by(F.struct("width", "height"), F.col("ord") if "ord" in pages.columns else F.lit(0)).alias("size")).select("doc", "page", "size.*")


def _height(page):
    return F.coalesce(F.col("pages")[page.cast("string")]["size"]["height"], F.lit(PAGE_HEIGHT).cast("float"))


def _flipped(b, page):
    zero = G.box(0, 0, 0, 0)
    return F.when(b.isNull(), zero).otherwise(G.to_top_left(b.l, b.t, b.r, b.b, b.coord_origin, _height(page)))


def docling_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and cells of docling JSON rows (doc and the DOCLING columns)."""
    each = docs.select("doc", "pages", F.posexplode("tables").alias("n", "t"))
    first = F.get(F.col("t.prov"), F.lit(0))
    page = F.coalesce(first.page_no, F.lit(1))
    each = each.withColumns({"page": page, "table_id": F.concat("doc", F.lit("#t"), F.col("n").cast("string"))})
    whole = G.box(0, 0, 0, _height(F.col("page")))
    tables = each.select("table_id", "doc", "page", F.col("t.data.num_rows").alias("n_rows"), F.col("t.data.num_cols").alias("n_cols"), F.when(first.isNull(), whole).otherwise(_flipped(first.bbox, F.col("page"))).alias("bbox"), F.col("n").alias("ord"))
    cells = each.select("table_id", "doc", "page", "pages", F.posexplode("t.data.table_cells").alias("ord", "c"))
    cells = cells.select("table_id", "doc", "page", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), "ord", "c.text", F.coalesce("c.column_header", F.lit(False)).alias("is_header"), _flipped(F.col("c.bbox"), F.col("page")).alias("bbox"))
    return tables, cells


def docling_regions(docs: DataFrame) -> DataFrame:
    """One region for each text, table and picture that has a place: doc, page, label, role, bbox."""
    def of(column: str, label) -> DataFrame:
        each = docs.select("doc", "pages", F.posexplode(column).alias("ord", "x"))
        first = F.get(F.col("x.prov"), F.lit(0))
        each = each.where(first.isNotNull()).withColumn("page", first.page_no)
        return each.select("doc", "page", "ord", label.alias("label"), _flipped(first.bbox, F.col("page")).alias("bbox"))

    out = of("texts", F.col("x.label")).unionByName(of("tables", F.lit("table"))).unionByName(of("pictures", F.lit("picture")))
    return out.withColumn("role", role_of(F.col("label")))


def docling_elements(docs: DataFrame) -> DataFrame:
    """doc, ord, role, text, page and bbox of a document's prose in reading order.

    The body's references are followed through groups and pictures, each once; text below a picture has the role Figure.
    """
    def walk(batches):
        import pandas as pd

        listed = lambda x: [] if x is None else list(x)
        for pdf in batches:
            out = []
            for doc, body, groups, pictures in zip(pdf.doc, pdf.body, pdf.groups, pdf.pictures):
                seen, stack, n = set(), [(r, False) for r in reversed(listed(body))], 0
                children = {"groups": listed(groups), "pictures": listed(pictures)}
                while stack:
                    ref, figure = stack.pop()
                    kind, _, number = ref.removeprefix("#/").partition("/")
                    if not number.isdigit():
                        continue
                    if kind == "texts":
                        out.append((doc, n, int(number), figure))
                        n += 1
                    elif kind in children and ref not in seen and int(number) < len(children[kind]):
                        seen.add(ref)
                        stack += [(r, figure or kind == "pictures") for r in reversed(listed(children[kind][int(number)]))]
            yield pd.DataFrame(out, columns=["doc", "ord", "n", "figure"])

    ref = lambda c: F.transform(c, lambda r: r["$ref"])
    tree = docs.select("doc", ref(F.col("body.children")).alias("body"), F.transform("groups", lambda g: ref(g.children)).alias("groups"), F.transform("pictures", lambda g: ref(g.children)).alias("pictures"))
    order = tree.mapInPandas(walk, "doc string, ord int, n int, figure boolean")
    texts = docs.select("doc", "pages", F.posexplode("texts").alias("n", "x"))
    first = F.get(F.col("x.prov"), F.lit(0))
    texts = texts.withColumn("page", F.coalesce(first.page_no, F.lit(1)))
    found = order.join(texts, ["doc", "n"]).where(F.trim("x.text") != "")
    role = F.when(F.col("figure"), "Figure").otherwise(role_of(F.col("x.label"), DOC_ROLES))
    return found.select("doc", "ord", role.alias("role"), F.array_join(words(F.col("x.text")), " ").alias("text"), "page", _flipped(first.bbox, F.col("page")).alias("bbox"))


def layout_regions(docs: DataFrame) -> DataFrame:
    """doc, ord, label, role, confidence, bbox (points) from layout JSON rows (doc and the LAYOUT columns)."""
    each = docs.select("doc", F.coalesce("scale", F.lit(1.0)).cast("float").alias("scale"), F.posexplode("regions").alias("ord", "r"))
    label = F.coalesce("r.label", F.lit("Table"))
    return each.select("doc", "ord", label.alias("label"), role_of(label).alias("role"), F.coalesce("r.confidence", F.lit(1.0).cast("float")).alias("confidence"), G.pixels_to_points(G.box_of(F.col("r.bbox")), F.col("scale")).alias("bbox"))


def cloud_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and cells from cloud JSON rows (doc and the CLOUD columns); a cell without a box takes its table's."""
    each = docs.select("doc", F.posexplode("tables").alias("ord", "t")).withColumn("table_id", F.concat("doc", F.lit("#c"), F.col("ord").cast("string")))
    tables = each.select("table_id", "doc", "t.page", "t.n_rows", "t.n_cols", G.box_of(F.col("t.bbox")).alias("bbox"), "ord")
    cells = each.select("table_id", "doc", "t.page", G.box_of(F.col("t.bbox")).alias("whole"), F.posexplode("t.cells").alias("ord", "c"))
    return tables, cells.select("table_id", "doc", "page", "c.row", "c.col", "ord", "c.text", F.coalesce("c.is_header", F.lit(False)).alias("is_header"), F.coalesce(G.box_of(F.col("c.bbox")), "whole").alias("bbox"))


def region_words(docs: DataFrame) -> DataFrame:
    """doc, ord, text and bbox of a region's words (doc and the LITEPARSE_REGION columns)."""
    return docs.select("doc", F.posexplode("words").alias("ord", "w")).select("doc", "ord", "w.text", G.box(F.col("w.x0"), F.col("w.y0"), F.col("w.x1"), F.col("w.y1")).alias("bbox"))


def liteparse_spans(docs: DataFrame) -> DataFrame:
    """Spans from text items with a place and size; blank ones are left out."""
    each = docs.select("doc", F.explode("pages").alias("p")).select("doc", "p.page", F.posexplode("p.textItems").alias("ord", "s")).where(F.trim("s.text") != "")
    b = G.box(F.col("s.x"), F.col("s.y"), F.col("s.x") + F.col("s.width"), F.col("s.y") + F.col("s.height"))
    return each.select("doc", "page", "ord", "s.text", b.alias("bbox"), F.coalesce("s.confidence", F.lit(1.0).cast("float")).alias("confidence"), F.lit(False).alias("rotated"))


def grid_cells(df: DataFrame, grid: str = "grid", boxes: str | None = None, header: str = "header_rows") -> tuple[DataFrame, DataFrame]:
    """Tables and cells of rows with a nested grid: table_id, the grid, optional boxes alike, and header rows (1 if null)."""
    n_cols = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
    tables = df.select("table_id", F.size(grid).alias("n_rows"), n_cols.alias("n_cols"))
    cells = df.select("table_id", F.coalesce(header, F.lit(1)).alias("_h"), *([boxes] if boxes else []), F.posexplode(grid).alias("row", "_cells"))
    cells = cells.select("table_id", "_h", "row", *([boxes] if boxes else []), F.posexplode("_cells").alias("col", "text"))
    b = G.box_of(F.get(F.get(F.col(boxes), F.col("row")), F.col("col"))) if boxes else F.lit(None).cast(G.BOX_TYPE)
    return tables, cells.select("table_id", "row", "col", (F.col("row") * 100_000 + F.col("col")).alias("ord"), F.coalesce("text", F.lit("")).alias("text"), (F.col("row") < F.col("_h")).alias("is_header"), F.coalesce(b, G.box(0, 0, 0, 0)).alias("bbox"))


def truth_tables(docs: DataFrame, doc: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Truth tables (truth_id, name, page, bbox, ord, column_types, difficulty) and their cells, whose table_id is the truth_id.

    doc: the column that names the document the truth is about. Without it the truth is about the only document at hand.
    """
    extra = [F.col(doc).alias("doc")] if doc else []
    each = docs.select(*extra, F.posexplode("tables").alias("ord", "t")).select(*(["doc"] if doc else []), "ord", "t.*")
    each = each.withColumn("table_id", F.concat_ws("#", "doc", "name") if doc else F.col("name"))
    _, cells = grid_cells(each.withColumn("header_rows", F.lit(1)), "cells")
    named = each.select(F.col("table_id").alias("truth_id"), *(["doc"] if doc else []), "name", "page", G.box_of(F.col("bbox")).alias("bbox"), "ord", F.coalesce("column_types", F.array().cast("array<string>")).alias("column_types"), "difficulty")
    return named, cells


def word_boxes(docs: DataFrame) -> DataFrame:
    """doc, ord, text and bbox of bare word boxes: rows of doc and words, an array of the WORDS structs."""
    return region_words(docs)


def remapped_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """docling rows whose page numbers count an extract's pages, with those of the whole document. pages: doc, sub, page.

    Numbers that the list leaves out stay as they are.
    """
    known = pages.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sub").cast("int"), F.col("page").cast("int")))).alias("_m"))
    out = docs.join(known, "doc", "left")
    new = lambda n: F.coalesce(F.col("_m")[n], n)
    moved = lambda c: F.transform(c, lambda x: x.withField("prov", F.transform(x.prov, lambda p: p.withField("page_no", new(p.page_no)))))
    renamed = F.transform_keys("pages", lambda k, _: F.coalesce(new(k.try_cast("int")).cast("string"), k))
    return out.withColumns({"pages": renamed} | {c: moved(c) for c in ("tables", "texts", "pictures")}).drop("_m")


def rebased(tables: DataFrame, cells: DataFrame, crops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and cells parsed from crops, put back on their pages. crops: table_id, page, x0 and y0 (the crop's corner)."""
    at = crops.select("table_id", F.col("page").alias("_page"), F.col("x0").alias("_x"), F.col("y0").alias("_y"))

    def moved(df: DataFrame) -> DataFrame:
        out = df.join(at, "table_id").withColumns({"page": F.col("_page"), "bbox": F.when(F.col("bbox").isNotNull(), G.crop_to_page(F.col("bbox"), F.col("_x"), F.col("_y")))})
        return out.drop("_page", "_x", "_y")

    return moved(tables), moved(cells)


def triage_pages(docs: DataFrame) -> DataFrame:
    return docs.select(*(f.split()[0] for f in TRIAGE.split(", ")))
