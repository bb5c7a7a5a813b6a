"""Seeds of questions in stages: names, else words of the dictionary, else near vectors; all questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.dictionary import dictionary_join
from folioscope.operators.evidence import seed_search
from folioscope.operators.graph import written
from folioscope.operators.order import top_per_group

#: Literal seeds of a question at most, vectors of a question at most, and the least similarity.
LITERAL_SEEDS = 8
VECTOR_SEEDS = 3
VECTOR_FLOOR = 0.45


def staged_seeds(
    questions: DataFrame,
    names: DataFrame,
    surfaces: DataFrame,
    probes: DataFrame,
    stored: DataFrame,
    literal: int = LITERAL_SEEDS,
    k: int = VECTOR_SEEDS,
    floor: float = VECTOR_FLOOR,
) -> DataFrame:
    """(q, node, score, mode): the seeds of each question (q, text) from the first stage that finds any.

    `names`: names (q, surface) tagged in questions that are among the surfaces (surface). `dictionary`: for questions
    without any, surfaces that stand in the text, those of most occurrences, ties in order of the surface. `vectors`:
    for questions still without any, the nearest stored vectors (node, v) of probes (q, vec) from the floor on. A
    question without seeds has one row of mode `no_seeds`. Each stage sees what the one before has left by an
    anti-join; null texts and questions without a vector fall through.
    """
    known = surfaces.select("surface").filter("surface IS NOT NULL").distinct()
    all_q = written(questions.select("q", "text").filter("q IS NOT NULL"), "questions")
    seed = lambda df, node, score, mode: df.select("q", F.col(node).alias("node"), score.cast("double").alias("score"), F.lit(mode).alias("mode"))

    tagged = names.select("q", "surface").distinct().join(known, "surface", "left_semi").join(all_q.select("q"), "q", "left_semi")
    first = written(seed(tagged, "surface", F.lit(1.0), "names"), "seeds-names")
    rest = all_q.join(first.select("q"), "q", "left_anti")
    hits = dictionary_join(rest, known, "q", "text")
    best = top_per_group(hits, ["q"], [F.desc("n"), F.asc("surface")], literal)
    second = written(seed(best, "surface", F.lit(1.0), "dictionary"), "seeds-dictionary")
    rest = written(rest.join(second.select("q"), "q", "left_anti").select("q").distinct(), "questions-left")
    near = seed_search(probes.join(rest, "q", "left_semi").select(F.col("q").alias("probe"), F.col("vec").alias("q")), stored, k, floor, 1e9)
    third = written(seed(near.withColumnRenamed("probe", "q"), "node", F.col("sim"), "vectors"), "seeds-vectors")
    none = rest.join(third.select("q"), "q", "left_anti").select("q", F.lit(None).cast("string").alias("node"), F.lit(0.0).alias("score"), F.lit("no_seeds").alias("mode"))
    return first.unionByName(second).unionByName(third).unionByName(none)
