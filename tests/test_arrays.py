"""Array and scalar functions on hand-made cases."""

import math

from pyspark.sql import functions as F

from corpusflow.functions import arrays as A
from corpusflow.functions import numeric as N


def value(spark, expression):
    return spark.range(1).select(expression).first()[0]


def ints(*v):
    return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")


def test_durations(spark):
    assert value(spark, A.parse_durations(F.lit("3 5 2"))) == [3, 5, 2]
    assert value(spark, A.parse_durations(F.lit("3 x"))) is None
    assert value(spark, A.format_durations(ints(3, 5))) == "3 5"
    assert value(spark, A.target_length(ints(3, 5, 2))) == 10
    assert value(spark, A.eos_pad(ints(3, 5))) == [3, 5, 0]


def test_ctc_required_length(spark):
    assert value(spark, A.ctc_required_length(ints(4, 4, 5), F.lit(1), 2)) == 4
    assert value(spark, A.ctc_required_length(ints(4), F.lit(0), 2)) == 1
    assert value(spark, A.ctc_required_length(ints(4, 4, 4), F.lit(9), 2)) == 18
    assert value(spark, A.ctc_required_length(ints(), F.lit(0), 2)) == 0


def test_crop_and_unpad(spark):
    assert value(spark, A.crop(ints(0, 1, 2, 3, 4), F.lit(0.26), F.lit(1.0), 4.0)) == [1, 2, 3]
    assert value(spark, A.crop(ints(0, 1), F.lit(5.0), F.lit(9.0), 4.0)) == []
    assert value(spark, A.crop(ints(0, 1), F.lit(0.0), F.lit(0.0), 4.0)) == []
    assert value(spark, A.unpad(ints(7, 8, 9), F.lit(2), F.lit(0))) == [7, 8]
    assert value(spark, A.unpad(ints(7, 8, 9), F.lit(0), F.lit(0))) == [0]


def test_frames(spark):
    assert value(spark, A.stack_frames(ints(*range(7)), 3)) == [[0, 1, 2], [3, 4, 5]]
    assert value(spark, A.stack_frames(ints(1), 3)) == []
    vectors = F.array(ints(1, 2), ints(3, 4), ints(5, 6))
    assert value(spark, A.pack_frames(vectors, 2)) == [[1, 2, 3, 4]]
    assert value(spark, A.pack_frames(vectors, 1)) == [[1, 2], [3, 4], [5, 6]]
    assert value(spark, A.transpose(vectors)) == [[1, 3, 5], [2, 4, 6]]
    assert value(spark, A.stretch(ints(1, 2), 2)) == [1, 1, 2, 2]


def test_shift_right_tokens(spark):
    assert value(spark, A.shift_right_tokens(ints(5, 6, 2), 2)) == [2, 5, 6]
    assert value(spark, A.shift_right_tokens(ints(5, 6), 2)) == [2, 5, 6]


def test_distances(spark):
    x, y = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.5), F.lit(-1.0))
    assert value(spark, A.dot(x, y)) == -0.5
    assert value(spark, A.absolute_distance(x, y)) == 3.5
    assert value(spark, A.squared_distance(x, y)) == 9.25
    assert value(spark, A.smooth_l1_distance(x, y)) == 0.125 + 2.5
    assert value(spark, A.cosine(x, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert math.isclose(value(spark, A.cosine(x, y)), -0.5 / (math.sqrt(5) * math.sqrt(3.25)))


def test_interval_frames_round_half_to_even(spark):
    # rate / hop = 1, so the ends themselves are rounded.
    frames = [value(spark, N.interval_frames(F.lit(s), F.lit(e), 1.0, 1)) for s, e in [(0.5, 1.5), (1.5, 2.5), (2.5, 3.5)]]
    assert frames == [2, 0, 2]


def test_bucketize(spark):
    given = [-1.0, 0.0, 0.5, 1.0, 4.0, 5.0]
    assert [value(spark, N.bucketize(F.lit(v), 0.0, 4.0, 6)) for v in given] == [0, 0, 1, 1, 4, 5]


def test_log_duration(spark):
    assert value(spark, N.duration_frames(N.log_duration(F.lit(7)))) == 7
    assert value(spark, N.duration_frames(F.lit(-3.0))) == 0
    assert value(spark, N.duration_frames(F.lit(3.0), is_pad=F.lit(True))) == 0
    assert value(spark, N.duration_frames(F.log1p(F.lit(1.25)), 2.0)) == 2


def test_hypothesis_score(spark):
    score = N.hypothesis_score(F.lit(-6.0), F.lit(4), 0.5, F.lit(2), 0.5, F.lit(-2.0), 0.5)
    assert value(spark, score) == -8.0 / 2
    assert value(spark, N.hypothesis_score(F.lit(float("nan")), F.lit(4))) == float("-inf")
