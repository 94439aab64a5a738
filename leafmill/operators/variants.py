"""Nested values of unknown depth (VARIANT) as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.running import Rounds


def traverse(docs: DataFrame, doc: str, json: Column) -> DataFrame:
    """doc, path, kind and value of everything inside JSON texts that isn't null, false, 0 or empty, the whole included.

    Paths are ``a.b[0].c``, of the whole empty; kind is that of the value (OBJECT, ARRAY, STRING, ...); value is text, for
    objects and arrays null. A level is exploded a round, by the built-in VARIANT functions, until a round finds no
    object and no array, so rounds are as many as the deepest text has levels. Texts that are no JSON have no row.
    """
    spark = docs.sparkSession
    rounds = Rounds(spark, "traverse")
    level = rounds.put(docs.select(doc, F.lit("").alias("path"), F.try_parse_json(json).alias("value")).where("value is not null and not is_variant_null(value)"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level.createOrReplaceTempView(name := f"level_{id(level)}")
        kind = "schema_of_variant(value) like 'OBJECT%' or schema_of_variant(value) like 'ARRAY%'"
        below = spark.sql(f"""
            SELECT t.`{doc}`, CASE WHEN v.key IS NULL THEN concat(t.path, '[', v.pos, ']') WHEN t.path = '' THEN v.key ELSE concat(t.path, '.', v.key) END AS path, v.value
            FROM (SELECT * FROM {name} WHERE {kind}) t, LATERAL variant_explode(t.value) v WHERE v.value IS NOT NULL AND NOT is_variant_null(v.value)
        """)
        spark.catalog.dropTempView(name)
        level = rounds.put(below)
    rounds.drop(level)
    if not levels:
        return spark.createDataFrame([], f"{doc} {docs.schema[doc].dataType.simpleString()}, path string, kind string, value string")
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    flat = rows.select(doc, "path", kind.alias("kind"), F.when(~kind.isin("OBJECT", "ARRAY"), F.try_variant_get("value", "$", "string")).alias("value"))
    empty = F.when(F.col("kind") == "STRING", F.col("value") == "").when(F.col("kind") == "BOOLEAN", F.col("value") == "false").otherwise(F.coalesce(F.expr("try_cast(value AS double)") == 0, F.lit(False)))
    return flat.where(F.col("value").isNull() | ~empty)


def links_inside(rows: DataFrame, doc: str) -> DataFrame:
    """doc, path and link: the traversed texts that are links to documents or addresses."""
    return rows.where((F.col("kind") == "STRING") & F.col("value").rlike("^(gdoc:|https?://)")).select(doc, "path", F.col("value").alias("link"))


def inline_images(rows: DataFrame, doc: str, url: Column | None = None) -> DataFrame:
    """doc, path, image and url: the inline objects of traversed documents and the address that they link to, if any."""
    element = r"^(.*\.|)inlineObjectElement\."
    inside = rows.where(F.col("path").rlike(element)).select(doc, F.regexp_extract("path", r"^((?:.*\.|)inlineObjectElement)\.", 1).alias("at"), F.regexp_extract("path", r"inlineObjectElement\.([^\[]*)$", 1).alias("field"), "value")
    found = inside.groupBy(doc, "at").agg(F.max(F.when(F.col("field") == "inlineObjectId", F.col("value"))).alias("image"), F.max(F.when(F.col("field") == "textStyle.link.url", F.col("value"))).alias("url"))
    return found.where("image is not null").select(doc, F.col("at").alias("path"), "image", "url")
