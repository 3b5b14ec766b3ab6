"""What is listed of a ball: its members, not all 65 places."""

import random

from pyspark.sql import functions as F

from millrace.llm import simhash as S


def test_members_of_a_ball_are_named_by_their_bits(spark):
    rng, rows = random.Random(5), []
    for held in (1, 2, 3, 64):
        for centre_in in (False, True):
            v = rng.getrandbits(64) - (1 << 63)
            bits = rng.sample(range(64), held)
            flipped = [(v ^ (1 << k)) if k < 63 else v ^ -(1 << 63) for k in bits]
            members = sorted(flipped + [v] * centre_in)
            mask = 0
            for m in members:
                mask |= m ^ v
            rows.append((v, mask, len(members), members[0], members[1:]))
    df = spark.createDataFrame(rows, "v long, bits long, n long, a long, want array<long>")
    for r in df.select("want", F.sort_array(F.expr(S._members("v", "bits", "n", "a"))).alias("got")).collect():
        assert r.got == r.want
