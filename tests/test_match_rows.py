"""Score surfaces within a row are those of the joined relations, gaps and masks included, and shuffle nothing but the rasters."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from brindle.operators import match
from brindle.plans import catalog


def test_same_as_the_relations(spark):
    rng = random.Random(3)
    made = [(k, [rng.choice([None, 0.5, -0.25]) if k % 3 == 0 and rng.random() < 0.2 else float(rng.randrange(2 + k % 5)) for _ in range(25)]) for k in range(40)]
    df = spark.createDataFrame([*made, (98, [1.0] * 25), (99, [None] * 25)], "k long, e array<float>")
    px = match.pixels(df, "k", "e", 5)
    for least, masked in ((2, False), (3, True)):
        crop = px.where("y between 1 and 2 and x between 2 and 4").select("k", (F.col("y") - 1).alias("dy"), (F.col("x") - 2).alias("dx"), F.col("v").alias("t"))
        own = match.crop_of(F.col("e"), 5, 1, 2, 2, 3)
        if masked:
            crop, own = crop.where("t > 1"), F.filter(own, lambda p: p["t"] > 1)
        want = match.score_surface(match.windows(px, "k", 2, 3, 5), crop, "k", least)
        surface = match.surface(F.col("e"), own, 5, 2, 3, least)
        got = df.select("k", F.inline(surface))
        assert sorted(got.collect()) == sorted(want.select("k", "oy", "ox", "score").collect())
        best = sorted(match.best_of(df, "k", surface, 2, 3).collect(), key=repr)
        assert best == sorted(match.best_match(want, "k", 2, 3).collect(), key=repr) and best


def test_only_rasters_move(spark):
    for name in ("best_variant", "anchored_match", "template_match_8x8", "template_match_masked"):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        assert out.getvalue().count("Exchange") == 1 and "Join" not in out.getvalue(), name
