"""Readers and writers: GeoJSON, road network XML, link statistics, pipe network files, coefficient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nesting depth of coordinates by geometry type.
DEPTH = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def read_geojson(spark: SparkSession, path: str, places: int = 6, by_line: bool = False) -> DataFrame:
    """type, points, lines, polygons, properties of each feature of GeoJSON documents: a file each, or, by_line, a line each,
    so that a large file is read in parallel.

    points, lines and polygons hold the coordinates in one, two or three levels of arrays of (x, y, z); x and y are
    rounded. A feature without type or coordinates, or with another depth than its type has, raises.
    """
    docs = spark.read.text(path, wholetext=not by_line).select(F.from_json("value", "type string, features array<string>, geometry string, properties string, coordinates string").alias("d"), "value")
    features = F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).when(F.col("d.type") == "Feature", F.array("value"))
    features = F.coalesce(features, F.array(F.concat(F.lit('{"type":"Feature","geometry":'), "value", F.lit(',"properties":{}}'))))
    one = docs.select(F.explode(features).alias("f")).select(F.from_json("f", "geometry string, properties string").alias("f"))
    g = one.select(F.from_json("f.geometry", "type string, coordinates string").alias("g"), F.col("f.properties").alias("properties"))
    kind, raw = F.col("g.type"), F.regexp_replace("g.coordinates", r"\s", "")
    depth = F.length(F.regexp_extract(raw, r"^(\[+)", 1))
    want = F.lit(None).cast("int")
    for name, n in DEPTH.items():
        want = F.when(kind == name, F.lit(n)).otherwise(want)
    bad = kind.isNull() | raw.isNull() | (depth != want) | want.isNull()
    kind = F.when(bad, F.raise_error(F.concat(F.lit("bad geometry: "), F.coalesce(F.to_json("g"), F.lit("null")))).cast("string")).otherwise(kind)

    def place(p: Column) -> Column:
        return F.struct(F.bround(p[0], places).alias("x"), F.bround(p[1], places).alias("y"), F.try_element_at(p, F.lit(3)).alias("z"))

    flat = F.from_json(F.when(depth == 1, F.concat(F.lit("["), raw, F.lit("]"))).when(depth == 2, raw), "array<array<double>>")
    rings = F.from_json(F.when(depth == 3, raw).when(depth == 2, F.concat(F.lit("["), raw, F.lit("]"))), "array<array<array<double>>>")
    many = F.from_json(F.when(depth == 4, raw).when(depth == 3, F.concat(F.lit("["), raw, F.lit("]"))), "array<array<array<array<double>>>>")
    return g.select(
        kind.alias("type"),
        F.when(kind.isin("Point", "MultiPoint"), F.transform(flat, place)).alias("points"),
        F.when(kind.isin("LineString", "MultiLineString"), F.transform(rings, lambda r: F.transform(r, place))).alias("lines"),
        F.when(kind.isin("Polygon", "MultiPolygon"), F.transform(many, lambda m: F.transform(m, lambda r: F.transform(r, place)))).alias("polygons"),
        "properties",
    )


def typed(properties: Column) -> Column:
    """Attributes as a variant, in which objects and arrays stay nested; see attribute for one of them by its type."""
    return F.parse_json(properties)


def attribute(variant: Column, name: str) -> Column:
    """One attribute as (kind, int_value, double_value, text): null, bool, string, table (an object) and array as they are, a
    number as a 32-bit integer if it is one and fits, otherwise as a double. Another type raises."""
    v = F.try_variant_get(variant, f"$.{name}", "variant")
    sort = F.schema_of_variant(v)
    whole = F.try_variant_get(variant, f"$.{name}", "int")
    number = F.try_variant_get(variant, f"$.{name}", "double")
    is_number = sort.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
    fits = is_number & (whole.cast("double") == number) & sort.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL[(][0-9]+,0[)])$")
    bad = F.raise_error(F.concat(F.lit("attribute of type "), sort)).cast("string")
    kind = (
        F.when(sort.isNull() | (sort == "VOID"), "null").when(sort == "BOOLEAN", "bool").when(sort == "STRING", "string").when(fits, "int").when(is_number, "double")
        .when(sort.startswith("OBJECT"), "table").when(sort.startswith("ARRAY"), "array").otherwise(bad)
    )
    return F.struct(kind.alias("kind"), F.when(fits, whole).alias("int_value"), F.when(is_number, number).alias("double_value"), F.try_variant_get(variant, f"$.{name}", "string").alias("text"))


def feature_json(geometry_type: Column, coordinates: Column, properties: Column) -> Column:
    """One GeoJSON feature as text."""
    geometry = F.struct(geometry_type.alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def with_bbox(feature: Column, points: Column) -> Column:
    """A feature's text with the box (least x, least y, largest x, largest y) of its points."""
    side = lambda f, k: f(F.transform(points, lambda p: p[k])).cast("string")
    box = F.concat(F.lit('{"bbox":['), side(F.array_min, "x"), F.lit(","), side(F.array_min, "y"), F.lit(","), side(F.array_max, "x"), F.lit(","), side(F.array_max, "y"), F.lit("],"))
    return F.concat(box, F.substr(feature, F.lit(2)))


def with_crs(document: Column, name: str) -> Column:
    """A collection's text with its reference system; an empty collection, which has none, raises."""
    empty = document.like('%"features":[]%')
    named = F.concat(F.lit('{"crs":{"type":"name","properties":{"name":"' + name + '"}},'), F.substr(document, F.lit(2)))
    return F.when(empty, F.raise_error(F.lit("an empty collection has no reference system")).cast("string")).otherwise(named)


def write_features(features: DataFrame, column: str, path: str) -> None:
    """One feature a line in as many files as there are partitions: this scales; see collection for one document."""
    features.select(F.col(column).alias("value")).write.text(path)


def collection(features: DataFrame, column: str) -> DataFrame:
    """All features as one FeatureCollection text. The document is a single value, so this is for small results."""
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list(column)), ","), F.lit("]}")).alias("value"))


def lines_to_features(lines: DataFrame, srid: int) -> DataFrame:
    """value: features of lines (id, pts) with number, place system, point count, simplicity and dimension."""
    p = F.col("pts")
    simple = F.size(F.array_distinct(p)) >= F.size(p) - F.when(F.element_at(p, 1) == F.element_at(p, -1), 1).otherwise(0)
    properties = F.struct(F.col("id").alias("curveId"), F.lit(srid).alias("srid"), F.size(p).alias("numPoints"), simple.alias("isSimple"), F.lit(3).alias("dimension"))
    return lines.select("id", feature_json(F.lit("LineString"), F.transform(p, lambda q: F.array(q["x"], q["y"], q["z"])), properties).alias("value"))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """id, modes (array), ax, ay, bx, by of the links of a network XML file. A link with an unknown node raises."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _x double, _y double").load(path)
    links = spark.read.format("xml").option("rowTag", "link").schema("_id string, _from string, _to string, _modes string").load(path)
    a = nodes.select(F.col("_id").alias("_from"), F.col("_x").alias("ax"), F.col("_y").alias("ay"))
    b = nodes.select(F.col("_id").alias("_to"), F.col("_x").alias("bx"), F.col("_y").alias("by"))
    both = links.join(a, "_from", "left").join(b, "_to", "left")
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("unknown node of link "), "_id")).cast("double")).otherwise(F.col(c)).alias(c)
    return both.select(F.col("_id").alias("id"), F.transform(F.split("_modes", ","), lambda m: F.trim(m)).alias("modes"), *map(known, ("ax", "ay", "bx", "by")))


def network_features(links: DataFrame, split: bool = False) -> DataFrame:
    """id, value: a LineString feature of each link of read_network with its id and modes, as one text or, with split, as a
    list."""
    at = lambda x, y: F.array(F.col(x), F.col(y))
    modes = F.col("modes") if split else F.array_join("modes", ",")
    properties = F.struct(F.col("id"), modes.alias("modes"))
    return links.select("id", feature_json(F.lit("LineString"), F.array(at("ax", "ay"), at("bx", "by")), properties).alias("value"))


def read_link_stats(spark: SparkSession, path: str) -> DataFrame:
    """LINK, FROM, TO, FREESPEED, CAPACITY and the hourly averages, volumes before travel times, from tab-separated
    text, compressed or not. A missing column raises."""
    df = spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    fixed = ["LINK", "FROM", "TO", "FREESPEED", "CAPACITY"]
    missing = [c for c in fixed if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    volumes = [c for c in df.columns if "HRS" in c and "avg" in c]
    times = [c for c in df.columns if "TRAVELTIME" in c and "avg" in c]
    return df.select(*fixed, *(F.col(f"`{c}`") for c in volumes + [t for t in times if t not in volumes])).where("LINK is not null")


def link_volumes(stats: DataFrame) -> DataFrame:
    """link_id, from_id, to_id, freespeed, hour, volume: one row an hour of the first 24 hourly columns."""
    hours = stats.columns[5:29]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("hour"), F.col(f"`{c}`").cast("double").alias("volume")) for k, c in enumerate(hours)])).alias("h")
    return stats.select(F.col("LINK").cast("int").alias("link_id"), F.col("FROM").cast("int").alias("from_id"), F.col("TO").cast("int").alias("to_id"), F.col("FREESPEED").cast("double").alias("freespeed"), rows).select("link_id", "from_id", "to_id", "freespeed", "h.hour", "h.volume")


def read_pipe_network(spark: SparkSession, path: str) -> DataFrame:
    """section, n, fields of the rows of sectioned text files: a section begins at [NAME] and ends at the first empty
    line; comments begin with a semicolon. A file is one row, so its lines keep their order."""
    text = spark.read.text(path, wholetext=True)
    sections = F.expr(r"regexp_extract_all(concat(replace(value, '\r', ''), '\n\n'), '(?s)\\[([A-Z]+)\\][^\\n]*\\n(.*?)\\n[ \\t]*\\n', 0)")
    one = text.select(F.explode(sections).alias("s")).select(F.regexp_extract("s", r"\[([A-Z]+)\]", 1).alias("section"), F.posexplode(F.slice(F.split("s", "\n"), F.lit(2), F.greatest(F.size(F.split("s", "\n")) - 1, F.lit(0)))).alias("n", "line"))
    line = F.trim(F.regexp_replace("line", ";.*$", ""))
    kept = one.where((F.length(line) > 0) & ~F.ltrim("line").startswith(";"))
    return kept.select("section", F.col("n").cast("long").alias("n"), F.transform(F.split(line, r"\t"), lambda x: F.trim(x)).alias("fields"))


def junctions(rows: DataFrame) -> DataFrame:
    """id, x, y, elevation of junctions with their coordinates."""
    f = F.col("fields")
    j = rows.where("section = 'JUNCTIONS'").select(f[0].alias("id"), F.try_element_at("fields", F.lit(2)).cast("double").alias("elevation"))
    c = rows.where("section = 'COORDINATES'").select(f[0].alias("id"), f[1].cast("double").alias("x"), f[2].cast("double").alias("y"))
    return j.join(c, "id").select("id", "x", "y", "elevation")


def pipes(rows: DataFrame) -> DataFrame:
    """id, from_id, to_id, pts: ends with the vertices between them in file order."""
    f = F.col("fields")
    p = rows.where("section = 'PIPES'").select(f[0].alias("id"), f[1].alias("from_id"), f[2].alias("to_id"))
    c = rows.where("section = 'COORDINATES'").select(f[0].alias("node"), F.struct(f[1].cast("double").alias("x"), f[2].cast("double").alias("y")).alias("at"))
    v = rows.where("section = 'VERTICES'").groupBy(f[0].alias("id")).agg(F.array_sort(F.collect_list(F.struct("n", F.struct(f[1].cast("double").alias("x"), f[2].cast("double").alias("y")).alias("p")))).alias("v"))
    both = p.join(c.select(F.col("node").alias("from_id"), F.col("at").alias("a")), "from_id").join(c.select(F.col("node").alias("to_id"), F.col("at").alias("b")), "to_id").join(v, "id", "left")
    inner = F.coalesce(F.transform("v", lambda x: x["p"]), F.array().cast("array<struct<x:double,y:double>>"))
    return both.select("id", "from_id", "to_id", F.concat(F.array("a"), inner, F.array("b")).alias("pts"))


def simplified(pipes_: DataFrame, tolerance: float) -> DataFrame:
    """Pipes with lines simplified by 1000 times the tolerance (in metres, where places are in millimetres)."""
    from polisgrid.operators.lines import simplify_lines

    return simplify_lines(pipes_, tolerance * 1000)


def elevated(pipes_: DataFrame, junctions_: DataFrame) -> DataFrame:
    """Pipes with the elevations of their ends as za and zb; a reservoir or other node without one counts 0."""
    z = junctions_.select("id", "elevation")
    a, b = (z.select(F.col("id").alias(f"{s}_id"), F.col("elevation").alias(c)) for s, c in (("from", "za"), ("to", "zb")))
    return pipes_.join(a, "from_id", "left").join(b, "to_id", "left").fillna(0.0, ["za", "zb"])


def reservoirs(rows: DataFrame) -> DataFrame:
    """id, x, y of reservoirs."""
    f = F.col("fields")
    c = rows.where("section = 'COORDINATES'").select(f[0].alias("id"), f[1].cast("double").alias("x"), f[2].cast("double").alias("y"))
    return rows.where("section = 'RESERVOIRS'").select(f[0].alias("id")).join(c, "id")


def read_blocks(spark: SparkSession, path: str, tag: str = "Block") -> DataFrame:
    """function, e_lo, e_hi, w_lo, w_hi, g_lo, g_hi of the blocks in an XML of coefficients, with pairs as buildings have."""
    return _pairs(spark, path, tag)


def read_design(spark: SparkSession, path: str) -> dict[str, list]:
    """The parameters of an urban-design XML: buildings (name, kind, priority, area, floors, depths, storey), and each other
    section as its rows (tag, attributes, values). The document is small and is parsed once, on the driver."""
    from xml.etree import ElementTree

    text = spark.read.text(path, wholetext=True).first()[0]
    root = ElementTree.fromstring(text.lstrip("\ufeff"))
    pair = lambda e, tag: tuple(float(v) for v in (e.findtext(tag) or "").split(",") if v.strip())
    out: dict[str, list] = {"buildings": []}
    for section in root:
        if section.tag == "BuildingParameters":
            for e in section:
                if e.find("Area") is not None and e.get("type"):
                    out["buildings"].append((e.tag, e.get("type"), int(e.get("priority") or 0), float(e.findtext("Area")), pair(e, "FloorRange"), pair(e, "DepthRange"), float(e.findtext("FloorHeight") or 0)))
            continue
        out[section.tag] = [(e.tag, dict(e.attrib), [v.strip() for v in (e.text or "").split(",") if v.strip()]) for e in section.iter() if e is not section and len(e) == 0]
    return out


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """type, floor_lo, floor_hi, per_person of population bands: elements with attributes Type, Layer (lo,hi) and the square
    metres a person as their text or attribute Index."""
    df = spark.read.format("xml").option("rowTag", "Population").schema("_Type int, _Layer string, _Index int, _VALUE string").load(path)
    pair = F.split("_Layer", ",")
    return df.select(F.col("_Type").alias("type"), pair[0].cast("int").alias("floor_lo"), pair[1].cast("int").alias("floor_hi"), F.coalesce("_Index", F.trim("_VALUE").cast("int")).alias("per_person"))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """function, e_lo, e_hi, w_lo, w_hi, g_lo, g_hi from an XML of buildings with pairs like 0.02,0.05."""
    return _pairs(spark, path, "Building")


def _pairs(spark: SparkSession, path: str, tag: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", tag).schema("_Type string, EConsumption string, WConsumption string, GConsumption string").load(path)
    pair = lambda c, p: (F.split(c, ",")[0].cast("double").alias(f"{p}_lo"), F.split(c, ",")[1].cast("double").alias(f"{p}_hi"))
    return df.select(F.col("_Type").alias("function"), *pair("EConsumption", "e"), *pair("WConsumption", "w"), *pair("GConsumption", "g"))
