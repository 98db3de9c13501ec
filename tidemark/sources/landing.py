"""Tables that drawn pages and word lists land in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import music_char

SCHEMAS = {
    "glyphs": "score_id string, ord long, page int, font string, ch string, x double, y double, x0 double, x1 double, size double",
    "words": "score_id string, ord long, page int, text string, x0 double, x1 double, y double, size double, font string",
    "lines": "score_id string, ord long, page int, x0 double, y0 double, x1 double, y1 double, width double",
    "beams": "score_id string, ord long, page int, pts array<struct<x:double,y:double>>, x0 double, x1 double",
    "curves": "score_id string, ord long, page int, x0 double, y0 double, x1 double, y1 double",
    "staves": "score_id string, ord long, system int, page int, x0 double, x1 double, lines array<double>, name string",
    "measures": "score_id string, idx int, number int, start double, length double, num int, den int, repeat_start boolean, repeat_end boolean, repeat_times int, fifths int, text string",
    "tempos": "score_id string, start double, qpm double",
    "notes": "score_id string, ord long, part string, voice int, start double, dur double, midi int, lyrics map<int,struct<text:string,hyphen_after:boolean>>, measure int, tie_start boolean, x_notehead boolean",
}


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The landing tables of a folder, by name, with their declared schemas."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}.parquet") for name, schema in SCHEMAS.items()}


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words of a text file, a word a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def land_characters(chars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """glyphs and words of drawn characters (score_id, page, ord, span, font, c, x, y, x0, x1, size; ord in drawing order). The font's name counts after a ``+``. Characters of music fonts (Opus, with Std behind the name if it lacks that) are glyphs, decoded from private-use codes; of other
    fonts each run of characters without a blank in a span is a word, as wide as they and at its first one's place. Blanks are neither."""
    named = chars.withColumn("font", F.element_at(F.split("font", "[+]"), -1))
    music = F.col("font").startswith("Opus")
    blank = F.trim(F.regexp_replace("c", "(?U)\\s", "")) == ""
    full = F.when(F.col("font").endswith("Std"), F.col("font")).otherwise(F.concat("font", F.lit("Std")))
    glyphs = named.where(music & ~blank).select("score_id", "ord", "page", full.alias("font"), music_char(F.col("c")).alias("ch"), "x", "y", "x0", "x1", "size")
    w = W.partitionBy("score_id", "page", "span").orderBy("ord")
    runs = named.where(~music).withColumn("__blank", blank).withColumn("__new", (F.col("__blank") | F.coalesce(F.lag("__blank").over(w), F.lit(True))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    letters = F.array_sort(F.collect_list(F.struct("ord", "c")))
    words = runs.where("not __blank").groupBy("score_id", "page", "span", "__run").agg(
        F.min("ord").alias("ord"), F.array_join(F.transform(letters, lambda s: s["c"]), "").alias("text"), F.min_by("x0", "ord").alias("x0"), F.max_by("x1", "ord").alias("x1"), F.min_by("y", "ord").alias("y"), F.min_by("size", "ord").alias("size"), F.min_by("font", "ord").alias("font")
    )
    return glyphs, words.select("score_id", "ord", "page", "text", "x0", "x1", "y", "size", "font")


def land_drawings(drawings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines, beams and curves of drawn paths (score_id, page, ord, kind: s stroke, f fill, fs both; width; items: array of struct op, x0, y0, x1, y1; box: struct x0, y0, x1, y1). A stroke of one line is a line, its upper (else left) end first; a fill made of lines only is a beam, with its
    corners; a fill with a curve is a curve, as its box."""
    ops = F.array_distinct(F.transform("items", lambda i: i["op"]))
    first = F.get("items", F.lit(0))
    down = F.struct(first["y0"], first["x0"]) <= F.struct(first["y1"], first["x1"])
    end = lambda a, b: F.when(down, first[a]).otherwise(first[b])
    strokes = drawings.where((F.col("kind") == "s") & (F.size("items") == 1) & (first["op"] == "l"))
    lines = strokes.select("score_id", "ord", "page", end("x0", "x1").alias("x0"), end("y0", "y1").alias("y0"), end("x1", "x0").alias("x1"), end("y1", "y0").alias("y1"), F.coalesce("width", F.lit(0.0)).alias("width"))
    corners = F.transform("items", lambda i: F.struct(i["x0"].alias("x"), i["y0"].alias("y")))
    xs = F.transform("items", lambda i: i["x0"])
    beams = drawings.where((F.col("kind") == "f") & (ops == F.array(F.lit("l")))).select("score_id", "ord", "page", corners.alias("pts"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"))
    curves = drawings.where(F.col("kind").isin("f", "fs") & F.array_contains(ops, "c")).select("score_id", "ord", "page", "box.x0", "box.y0", "box.x1", "box.y1")
    return lines, beams, curves
