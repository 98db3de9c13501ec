"""python -m tidemark LANDING OUT: the scores of a folder of landing tables, as tables and MusicXML files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import tempo_spec, tempo_text
from .operators import ordered, structure
from .plans import musicxml, score
from .sources import landing


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("landing", help="folder of glyphs, words, lines, beams and curves (Parquet)")
    parser.add_argument("out", help="folder for the tables and the documents")
    parser.add_argument("--tempo", help="instead of the first tempo, the others in proportion: 8=116, 4.=39, 4=58 or quarters a minute")
    parser.add_argument("--part", default="all", help="only this part (name or full name)")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    tables = {n: spark.read.schema(landing.SCHEMAS[n]).parquet(f"{a.landing}/{n}.parquet") for n in ("glyphs", "words", "lines", "beams", "curves")}
    found = score.read_score(tables)
    if a.tempo:
        qpm = spark.range(1).select(tempo_spec(F.lit(a.tempo))["qpm"].alias("q")).first()["q"]
        if qpm is None:
            parser.error(f"tempo not understood: {a.tempo}")
        found["tempos"] = ordered.rescale_to_first(found["tempos"], ["score_id"], ["start"], "qpm", F.lit(qpm))
    if a.part != "all":
        found["parts"] = structure.select_parts(found["parts"], ["score_id"], a.part, "ord", "part")
        found["notes"] = found["notes"].join(found["parts"].select("score_id", "part"), ["score_id", "part"], "left_semi")
    for name, table in found.items():
        table.write.mode("overwrite").parquet(f"{a.out}/{name}")
    documents = musicxml.score_xml(*(found[n] for n in ("scores", "notes", "measures", "parts", "tempos")))
    documents.write.mode("overwrite").partitionBy("score_id").text(f"{a.out}/musicxml")
    first = found["tempos"].groupBy("score_id").agg(F.min_by("qpm", "start").alias("qpm")).select("score_id", tempo_text(F.col("qpm")).alias("tempo"))
    found["scores"].join(first, "score_id", "left").show(truncate=False)


if __name__ == "__main__":
    main()
