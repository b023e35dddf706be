"""Joins, filters, aggregates, batching, mixing, scoring on hand-made cases."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.text import numbered_13a, tokenize_13a, words
from corpusflow.operators import aggregates, batching, bleu, filters, hypotheses, joins, mixing, similarity
from corpusflow.operators.quarantine import for_extraction, for_scoring, safe_map
from corpusflow.operators.sequences import exploded
from corpusflow.operators.transforms import TransformRegistry, chosen
from corpusflow.sources.vocab import speaker_ids, vocab_ids


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# lookups and joins


def test_override_target_last_line_wins(spark):
    clips = table(spark, "path string, translation string", ("a", "x"), ("b", "y"))
    target = table(spark, "path string, text string, line_no int", ("a", "1", 0), ("a", "2", 7), ("a", "3", 4), ("c", "4", 5))
    assert rows_of(joins.override_target(clips, target), "path", "translation") == [("a", "2")]


def test_merge_registry(spark):
    source = table(spark, "id string, src_audio string, src_n_frames int, priority int", ("a.mp3", "s1", 1, 0), ("b", "s2", 2, 0))
    target = table(
        spark, "id string, tgt_audio string, tgt_n_frames int, pitch int, energy int, priority int",
        ("a", "t1", 1, 1, 1, 0), ("a.mp3", "t2", 2, 2, 2, 5), ("c", "t3", 3, 3, 3, 0),
    )
    merged = joins.merge_registry(source, target)
    assert rows_of(merged, "id", "src_audio", "tgt_audio", "n_source", "n_target") == [
        ("a", "s1", "t2", 1, 2), ("b", "s2", None, 1, 0), ("c", None, "t3", 0, 1)
    ]


def registry(spark):
    return table(
        spark, "id string, src_audio string, src_n_frames int, tgt_audio string, tgt_n_frames int, pitch string, energy string",
        ("a", "sa", 10, "ta", 20, "pa", "ea"), ("b", "sb", 11, None, None, None, None),
    )


def test_fill_manifest_layouts(spark):
    bare = table(spark, "id string, src_audio string", ("a.mp3", "old"))
    assert rows_of(joins.fill_manifest(bare, registry(spark), "s2s"), "src_audio", "src_n_frames") == [("sa", 10)]
    full = bare.withColumn("tgt_audio", F.lit("old"))
    got = joins.fill_manifest(full, registry(spark), "s2s")
    assert rows_of(got, "src_audio", "tgt_audio", "tgt_n_frames", "pitch", "energy") == [("sa", "ta", 20, "pa", "ea")]
    speech = joins.fill_manifest(bare.select("id"), registry(spark), "speech2unigram")
    assert rows_of(speech, "id", "audio", "n_frames") == [("a.mp3", "sa", 10)]
    tts = joins.fill_manifest(bare.select("id"), registry(spark), "tts")
    assert rows_of(tts, "audio", "n_frames", "pitch", "energy") == [("ta", 20, "pa", "ea")]


def test_fill_manifest_missing_id(spark):
    manifest = table(spark, "id string", ("a",), ("z",), ("b",))
    with pytest.raises(Exception, match="not in the registry: z"):
        joins.fill_manifest(manifest, registry(spark), "s2s").collect()
    assert rows_of(joins.missing_from_registry(manifest, registry(spark), "s2s"), "id") == [("z",)]
    assert rows_of(joins.missing_from_registry(manifest, registry(spark), "tts"), "id") == [("b",), ("z",)]


def test_positions(spark):
    left = table(spark, "idx bigint, prediction string", (0, "a"), (1, "b"))
    right = table(spark, "idx bigint, reference string", (1, "B"), (2, "C"))
    assert rows_of(joins.align_by_position(left, right), "idx", "prediction", "reference") == [(1, "b", "B")]
    assert rows_of(joins.unpaired_positions(left, right), "idx", "only_in") == [(0, "prediction"), (2, "reference")]


def test_encode_tokens_and_back(spark):
    text = table(spark, "id int, text string", (1, "a b a z"), (2, "b"), (3, ""), (None, "a"))
    vocab = vocab_ids(table(spark, "token string, count int", ("a", 3), ("b", 2)), [F.desc("count"), F.col("token")])
    tokens = exploded(text, ["id"], token=words(F.col("text")))
    encoded = joins.encode_tokens(tokens, vocab, text)
    wanted = [(1, [4, 5, 4, 3, 2], 4, 1), (2, [5, 2], 1, 0), (3, [2], 0, 0), (None, [4, 2], 1, 0)]
    assert rows_of(encoded, "id", "ids", "n_tokens", "n_oov") == sorted(wanted, key=str)
    back = rows_of(joins.decode_ids(encoded, vocab), "id", "symbols")
    assert back == sorted([(1, ["a", "b", "a", "<unk>", "</s>"]), (2, ["b", "</s>"]), (3, ["</s>"]), (None, ["a", "</s>"])], key=str)


def test_encode_tokens_with_a_large_vocabulary_and_nested_maps(spark):
    vocab = spark.range(30_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), F.col("id").alias("id"))
    text = table(spark, "id int, text string", (1, "w29999 w7 x"))
    tokens = exploded(text, ["id"], token=words(F.col("text")))
    nested = tokens.with_columns({"m": F.array(F.create_map(F.lit("k"), F.lit(1)))})
    assert rows_of(joins.encode_tokens(nested, vocab, text), "id", "ids") == [(1, [29_999, 7, 3, 2])]


def test_dense_ids(spark):
    vocab = table(spark, "token string, count int", ("x", 1), ("y", 5), ("w", 1))
    order = [F.desc("count"), F.col("token")]
    wanted = [("</s>", 2), ("<pad>", 1), ("<s>", 0), ("<unk>", 3), ("w", 5), ("x", 6), ("y", 4)]
    assert rows_of(vocab_ids(vocab, order), "token", "id") == wanted
    speakers = table(spark, "speaker string", ("b",), ("a",), ("b",))
    assert rows_of(speaker_ids(speakers), "speaker", "id") == [("a", 0), ("b", 1)]
    assert rows_of(joins.speaker_column(speakers, speaker_ids(speakers)), "speaker", "speaker_id") == [("a", 0), ("b", 1), ("b", 1)]


# filters


def test_select_split(spark):
    df = table(spark, "split string", ("train",), ("train_covost",), ("dev",))
    assert filters.select_split(df, "train").count() == 2
    assert filters.select_split(df, "dev").count() == 1
    assert filters.check_train_splits("train,train_b") == ["train", "train_b"]
    with pytest.raises(ValueError):
        filters.check_train_splits("train,dev")


def test_valid_direction(spark):
    df = table(spark, "src_lang string, tgt_lang string", ("fr", "en"), ("en", "fr"), ("en", "de"), ("de", "fr"), ("en", "en"))
    assert rows_of(filters.valid_direction(df), "src_lang", "tgt_lang") == [("en", "de"), ("fr", "en")]
    with pytest.raises(ValueError):
        filters.valid_direction(df, version=1)


def test_all_or_nothing(spark):
    df = table(spark, "split string, a int, b int", ("x", 1, None), ("x", 2, 3), ("y", None, 4))
    got = filters.all_or_nothing(df, ["a", "b"])
    assert rows_of(got, "split", "a", "b") == [("x", 1, None), ("x", 2, None), ("y", None, 4)]


def test_with_optional(spark):
    df = table(spark, "id int, speaker string", (1, None), (2, "x"))
    got = filters.with_optional(df, {"speaker": "none", "tgt_text": ""})
    assert rows_of(got, "id", "speaker", "tgt_text") == [(1, "none", ""), (2, "x", "")]


def test_max_positions(spark):
    df = table(spark, "id int, task string, s int, t int", (1, "st", 6000, 1024), (2, "st", 6001, 1), (3, "tts", 1025, 1), (4, "s2st", 1, 1200), (5, "?", 1, 1), (6, "st", 5, None))
    kept, rejected = filters.max_positions_filter(df, "s", "t", F.col("task"))
    assert [r[0] for r in rows_of(kept, "id")] == [1, 4, 6]
    assert [r[0] for r in rows_of(rejected, "id")] == [2, 3, 5]


# aggregates


def test_log_sum_exp_survives_wide_ranges(spark):
    values = {"a": [-1000.0, -1000.5, -2000.0], "b": [700.0, 710.0, -5.0], "c": [float("-inf")], "d": [float("-inf"), 0.0]}
    df = table(spark, "k string, v double", *[(k, v) for k, vs in values.items() for v in vs])
    got = {r["k"]: r["lse"] for r in aggregates.log_sum_exp(df, ["k"], F.col("v")).collect()}
    for k, vs in values.items():
        top = max(vs)
        wanted = top if top == float("-inf") else top + math.log(sum(math.exp(v - top) for v in vs))
        assert got[k] == wanted or math.isclose(got[k], wanted, rel_tol=1e-12, abs_tol=1e-12)
    averaged = {r["k"]: r["log_prob"] for r in aggregates.ensemble_logavg(df, ["k"], F.col("v")).collect()}
    assert math.isclose(averaged["d"], -math.log(2))


def test_reduce_metrics(spark):
    logs = table(spark, "st_loss double, l1_loss double, sample_size int", (1.0, 0.1234, 1), (2.0, None, 2))
    assert rows_of(aggregates.reduce_metrics(logs, ["st_loss", "l1_loss"]), "key", "value") == [("l1", 0.041), ("st", 1.0)]
    nothing = logs.withColumn("sample_size", F.lit(0))
    assert rows_of(aggregates.reduce_metrics(nothing, ["st_loss"]), "key", "value") == [("st", 0.0)]


def test_cmvn_round_trip(spark):
    df = table(spark, "id int, v array<double>", (1, [1.0, 5.0]), (2, [3.0, 5.0]))
    stats = aggregates.cmvn_stats(df, F.col("v"))
    assert rows_of(stats, "dim", "mean", "std") == [(0, 2.0, 1.0), (1, 5.0, 1e-5)]
    normal = aggregates.cmvn_apply(df, "v", stats)
    assert rows_of(normal, "id", "v") == [(1, [-1.0, 0.0]), (2, [1.0, 0.0])]
    assert rows_of(aggregates.cmvn_invert(normal, "v", stats), "id", "v") == rows_of(df, "id", "v")
    assert aggregates.cmvn_apply(df, "v", None) is df


def test_size_ratios(spark):
    sizes = table(spark, "lang string, n bigint", ("a", 90), ("b", 10))
    ratios = {r["lang"]: r["size_ratio"] for r in aggregates.size_ratios(sizes, 0.5).collect()}
    weight = {"a": math.sqrt(0.9), "b": math.sqrt(0.1)}
    for lang, share in (("a", 0.9), ("b", 0.1)):
        assert math.isclose(ratios[lang], weight[lang] / sum(weight.values()) / share)
    assert all(math.isclose(r["size_ratio"], 1.0) for r in aggregates.size_ratios(sizes, 1.0).collect())


# BLEU


def bleu_of(spark, *pairs):
    df = table(spark, "idx int, prediction string, reference string", *[(i, p, r) for i, (p, r) in enumerate(pairs)])
    return bleu.corpus_bleu(df).first()


def loop_bleu(pairs):
    """The published formula, for texts without symbols."""
    match, total, hyp_len, ref_len = [0] * 5, [0] * 5, 0, 0
    for hyp, ref in ((p.split(), r.split()) for p, r in pairs):
        hyp_len, ref_len = hyp_len + len(hyp), ref_len + len(ref)
        for n in range(1, 5):
            grams = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (hyp, ref)]
            match[n] += sum(min(c, grams[1][g]) for g, c in grams[0].items())
            total[n] += max(len(hyp) - n + 1, 0)
    if not any(match) or 0 in total[1:]:
        return 0.0
    logs, smooth = 0.0, 1
    for n in range(1, 5):
        if match[n] == 0:
            smooth *= 2
            logs += math.log(100 / (smooth * total[n]))
        else:
            logs += math.log(100 * match[n] / total[n])
    penalty = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return penalty * math.exp(logs / 4)


@pytest.mark.parametrize(
    "pairs",
    [
        [("a b c d e", "a b c d e")],
        [("a a a a", "a b c d e f")],
        [("a b c", "a b c")],
        [("", "a b")],
        [("x y z w", "a b c d")],
        [("a b x d e", "a b c d e"), ("f g", "f g h")],
        [("the cat the cat on the mat", "the cat is on the mat"), ("a b c d e f", "a b c d e")],
    ],
)
def test_bleu_formula(spark, pairs):
    assert math.isclose(bleu_of(spark, *pairs)["bleu"], loop_bleu(pairs), abs_tol=1e-9)


def test_bleu_identity_and_groups(spark):
    assert math.isclose(bleu_of(spark, ("It's a test, of 4 words.", "It's a test, of 4 words."))["bleu"], 100.0)
    df = table(
        spark, "idx int, lang string, prediction string, reference string",
        (0, "fr", "a b c d e", "a b c d e"), (1, "de", "a b c d", "a b c e"), (2, "de", "q", "q"),
    )
    got = {r["lang"]: r["bleu"] for r in bleu.corpus_bleu(df, by=["lang"]).collect()}
    assert math.isclose(got["fr"], 100.0)
    assert math.isclose(got["de"], loop_bleu([("a b c d", "a b c e"), ("q", "q")]))


def test_bleu_counts_before_shuffling(spark):
    """N-grams are counted between the layout and the tiny last shuffle; one aggregation, over sentences."""
    df = spark.range(10).select(F.col("id").alias("idx"), F.lit("a b c d").alias("prediction"), F.lit("a b").alias("reference"))
    plan = bleu.corpus_bleu(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_lay") == 1
    assert plan.count("Exchange") == 2 and plan.count("HashAggregate") == 2


def test_bleu_takes_distinct_words_apart_and_not_lines(spark):
    """Lines go to the tasks as they are: no rule of the tokenizer runs over them, and no token list is made of them."""
    df = spark.range(10).select(F.col("id").alias("idx"), F.lit("a, b").alias("prediction"), F.lit("a b").alias("reference"))
    plan = bleu.corpus_bleu(df)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "regexp_replace" not in plan and "split(" not in plan


@pytest.mark.parametrize("at_once", [1, 40, 1 << 19])
def test_matches_of_each_pair(monkeypatch, at_once):
    monkeypatch.setattr(bleu, "BYTES_AT_ONCE", at_once)
    draw = random.Random(at_once)
    hyps, refs = ([" ".join(draw.choices("ab.c,", k=draw.randint(0, 12))) for _ in range(60)] for _ in range(2))
    sides, found = [pa.array(side, pa.string()) for side in (hyps, refs)], []
    for run in bleu._slices(*sides):
        words, sizes = numbered_13a(pa.concat_arrays([side[run] for side in sides]))
        found += bleu._sentence_matches(words, sizes).tolist()
    wanted = []
    for pair in zip(hyps, refs, strict=True):
        tokens = [side.split() for side in pair]
        grams = [[Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in tokens] for n in range(1, 5)]
        wanted.append([(ours & theirs).total() for ours, theirs in grams])
    assert found == wanted


def test_bleu_of_bytes_that_are_no_text(spark):
    broken = F.unhex(F.lit("61FF6220632064")).cast("string")
    df = spark.range(1).select(F.col("id").alias("idx"), broken.alias("prediction"), broken.alias("reference"))
    row = bleu.corpus_bleu(df).first()
    assert row["hyp_len"] == row["ref_len"] == 3 and row["precision3"] == 100.0


def test_bleu_of_a_repeated_key(spark):
    df = table(spark, "idx int, prediction string, reference string", (0, "a b c d e", "v w x y z"), (0, "v w x y z", "a b c d e"))
    assert bleu.corpus_bleu(df).first()["bleu"] == 0.0


# batches


def test_token_batches_stay_in_budget(spark):
    lengths = [(i, (i * 37) % 900 + 1) for i in range(600)] + [(1000, 5000), (1001, 7000), (1002, 0)]
    df = table(spark, "id bigint, n bigint", *lengths)
    for salt_rows in (10_000, 20):
        batches = batching.token_batches(df, "n", "id", max_tokens=4000, max_rows=16, rows_per_salt=salt_rows)
        groups = {}
        for r in batches.collect():
            groups.setdefault((r["bucket"], r["salt"], r["batch"]), []).append((r["id"], r["n"]))
        assert sorted(i for g in groups.values() for i, _ in g) == sorted(i for i, _ in lengths)
        for group in groups.values():
            assert len(group) == 1 or (max(n for _, n in group) * len(group) <= 4000 and len(group) <= 16)
    assert sum(len(g) == 1 and g[0][1] > 4000 for g in groups.values()) == 2


def test_pad_collate(spark):
    df = table(spark, "id int, ids array<int>, bucket int, salt int, batch int", (1, [5, 6], 0, 0, 0), (2, [7, 8, 9], 0, 0, 0), (3, [4], 0, 0, 1))
    first, second = batching.pad_collate(df, "id", "ids", 1).orderBy("batch").collect()
    assert first["keys"] == [2, 1] and first["tokens"] == [[7, 8, 9], [5, 6, 1]] and first["lengths"] == [3, 2]
    assert first["mask"] == [[True, True, True], [True, True, False]] and first["ntokens"] == 5
    assert second["tokens"] == [[4]] and second["nsentences"] == 1


def test_padding_waste(spark):
    df = table(spark, "batch int, n int", (0, 4), (0, 2), (1, 3), (2, 0))
    assert rows_of(aggregates.padding_waste(df, ["batch"], "n"), "batch", "waste") == [(0, 0.25), (1, 0.0), (2, 0.0)]


def test_orders_cover_the_table(spark):
    df = spark.range(50).select("id", (F.col("id") % 5).alias("n"))
    expected = [(-n, i) for n, i in sorted((-(i % 5), i) for i in range(50))]
    got = batching.length_order(df, "n", "id").orderBy("pos").collect()
    assert [(r["n"], r["id"]) for r in got] == [(n, i) for n, i in expected]
    shuffled = [[r["id"] for r in batching.epoch_shuffle(d, ["id"], 1, 2).orderBy("pos").collect()] for d in (df, df.repartition(7))]
    assert shuffled[1] == shuffled[0] and sorted(shuffled[1]) == list(range(50)) and shuffled[1] != list(range(50))
    other = [r["id"] for r in batching.epoch_shuffle(df, ["id"], 1, 3).orderBy("pos").collect()]
    assert other != shuffled[1]
    trained = batching.length_order(df, "n", "id", shuffle=True, seed=3).orderBy("pos").collect()
    assert [r["n"] for r in trained] == [n for n, _ in expected] and [r["id"] for r in trained] != [i for _, i in expected]


def test_shards_are_a_partition(spark):
    df = spark.range(40)
    shards = [{r["id"] for r in batching.shard(df, 3, k, F.col("id")).collect()} for k in range(3)]
    assert set.union(*shards) == set(range(40)) and sum(map(len, shards)) == 40
    with pytest.raises(ValueError):
        batching.shard(df, 3, 3, F.col("id"))


# mixing


def test_sample_copies(spark):
    df = spark.range(2000)
    count = lambda ratio: mixing.sample_copies(df, ["id"], ratio).count()
    assert count(1.0) == 2000 and count(2.0) == 4000 and count(0.0) == 0
    assert abs(count(0.5) - 1000) < 120 and abs(count(1.5) - 3000) < 120
    assert mixing.sample_copies(df, ["id"], 2.5).select("id", "copy").distinct().count() == count(2.5)


def test_resample(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 80, "big").otherwise("small").alias("lang"))
    ratios = table(spark, "lang string, n bigint, size_ratio double", ("big", 80, 0.5), ("small", 20, 2.0))
    got = mixing.resample(df, "lang", ["id"], ratios).collect()
    big, small = [r for r in got if r["lang"] == "big"], [r for r in got if r["lang"] == "small"]
    assert len(big) == 40 and len({r["id"] for r in big}) == 40
    assert len(small) == 40 and sorted(r["draw"] for r in small) == list(range(40))
    assert {r["id"] for r in small} <= set(range(80, 100)) and len({r["id"] for r in small}) < 20
    whole = table(spark, "lang string, n bigint, size_ratio double", ("big", 80, 1.0), ("small", 20, 1.0))
    assert mixing.resample(df, "lang", ["id"], whole).count() == 100


def test_concat_splits(spark):
    a, b = table(spark, "id int, x int", (1, 2)), table(spark, "id int", (3,))
    assert rows_of(mixing.concat_splits({"a": a, "b": b, "c": b}, "a,b"), "id", "x", "split") == [(1, 2, "a"), (3, None, "b")]


# hypotheses


def test_nbest(spark):
    df = table(spark, "item int, hyp int, s double, n int", (1, 1, -1.0, 3), (1, 2, -1.0, 3), (1, 3, float("-inf"), 3), (1, 4, 5.0, 900), (2, 5, -9.0, 1))
    got = hypotheses.nbest_rank(df, ["item"], "hyp", F.col("s"), 2, F.col("n"))
    assert rows_of(got, "item", "hyp", "rank") == [(1, 1, 1), (1, 2, 2), (2, 5, 1)]


def test_no_repeat_ngram(spark):
    df = table(spark, "id int, t array<string>", (1, "a b c a b c".split()), (2, "a b a c".split()), (3, ["a"]), (4, []))
    kept = lambda n: [r[0] for r in rows_of(hypotheses.no_repeat_ngram(df, F.col("t"), n), "id")]
    assert kept(3) == [2, 3, 4] and kept(1) == [3, 4] and kept(0) == [1, 2, 3, 4] and kept(2) == [2, 3, 4]


def test_one_best(spark):
    df = table(spark, "item int, hyp int, t array<string>, s double", (1, 2, ["▁b"], 0.5), (1, 1, ["▁a", "</s>"], 0.5), (1, 3, ["▁c"], 0.1))
    assert rows_of(hypotheses.one_best(df, ["item"], "hyp", "t", F.col("s")), "item", "hyp", "text") == [(1, 1, "a")]


# similarity


def vectors(spark, *values, start=0):
    return table(spark, "pos bigint, vec array<double>", *[(start + i, list(v)) for i, v in enumerate(values)])


def test_contrastive_score(spark):
    x1, x2 = [(0.0, 1.0), (2.0, 0.5), (1.0, 1.0)], [(0.1, 1.0), (1.5, 0.0), (0.0, 0.0)]
    pairs = similarity.pair_similarity(vectors(spark, *x1), vectors(spark, *x2), "l1", batch_rows=3)
    assert pairs.count() == 9
    logits = [[-sum(abs(a - b) for a, b in zip(u, v)) / 0.1 for v in x2] for u in x1]
    lse = lambda line: max(line) + math.log(sum(math.exp(v - max(line)) for v in line))
    wanted = -0.5 * sum(2 * logits[i][i] - lse(logits[i]) - lse([row[i] for row in logits]) for i in range(3)) / 3
    assert math.isclose(similarity.contrastive_score(pairs, 0.1).first()["score"], wanted)


def test_pairs_stay_in_their_batch(spark):
    many = vectors(spark, *[(float(i),) for i in range(10)])
    pairs = similarity.pair_similarity(many, many, "dot", batch_rows=4)
    assert pairs.count() == 16 + 16 + 4
    twice = many.union(many.limit(1))
    with pytest.raises(Exception, match="not be bounded"):
        similarity.pair_similarity(many, twice, "dot", batch_rows=4).collect()


# transforms and user functions


def test_transform_choice():
    config = {
        "source_transforms": {"_train": ["old"]},
        "source_feature_transforms": {"dev": ["d"], "*": ["any"]},
        "source_waveform_transforms": {"_eval": ["w"]},
    }
    assert chosen(config, "source", "train", True) == ["old", "any"]
    assert chosen(config, "source", "dev", False) == ["d"]
    assert chosen(config, "source", "test", False) == ["any"]
    assert chosen(config, "source", "test", False, "waveform") == ["w"]
    assert chosen(config, "target", "train", True) == []
    with pytest.raises(ValueError):
        chosen(config, "middle", "train", True)


def test_registry(spark):
    registry = TransformRegistry()
    registry.register("plus")(lambda df: df.withColumn("id", F.col("id") + 1))
    with pytest.raises(ValueError):
        registry.register("plus")(lambda df: df)
    config = {"target_feature_transforms": {"*": ["plus", "plus"]}}
    assert [r["id"] for r in registry.apply(spark.range(1), config, "target", "x", False).collect()] == [2]


def test_safe_map(spark):
    from pyspark.sql import types as T

    df = table(spark, "id int, v string", (1, "7"), (2, "x"), (3, None))
    mapped = safe_map(df, lambda v: int(v) * 2, "v", T.LongType())
    assert rows_of(mapped, "id", "value") == [(1, 14), (2, None), (3, None)]
    good, bad = for_extraction(mapped)
    assert rows_of(good, "id") == [(1,)] and [r["error"].split(":")[0] for r in bad.orderBy("id").collect()] == ["ValueError", "TypeError"]
    assert rows_of(safe_map(df, len, "v", T.LongType(), keep=True), "id", "v", "value") == [(1, "7", 1), (2, "x", 1), (3, None, None)]
    text = safe_map(df, lambda v: v.upper(), "v", T.StringType())
    assert rows_of(for_scoring(text), "id", "value") == [(1, "7"), (2, "X"), (3, "")]


def test_all_or_nothing_and_summary_of_a_null_split(spark):
    df = table(spark, "split string, pitch int, text string", (None, 1, "a b"), (None, 2, "a"), ("x", None, "c"), ("x", 3, None))
    assert rows_of(filters.all_or_nothing(df, ["pitch"]), "split", "pitch") == sorted([(None, 1), (None, 2), ("x", None), ("x", None)], key=str)
    summary = aggregates.split_summary(df, "split", F.lit(1), words(F.col("text")))
    assert rows_of(summary, "split", "n_tokens", "vocab_size") == sorted([(None, 3, 2), ("x", 1, 1)], key=str)


def test_log_sum_exp_over_many_ranges(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 100.0).alias("v")).union(table(spark, "k int, v double", (2, 63.0), (2, 64.0), (2, -900.0), (3, None)))
    got = {r["k"]: r["lse"] for r in aggregates.log_sum_exp(df, ["k"], F.col("v")).collect()}
    assert math.isclose(got[1], 19_999 * 100.0) and math.isclose(got[2], 64 + math.log1p(math.exp(-1))) and got[3] == float("-inf")
    plan = aggregates.log_sum_exp(df, ["k"], F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_a_repeated_target_does_not_multiply_samples(spark):
    df, twice = table(spark, "id int", (1,), (2,)), table(spark, "id int, target int", (1, 5), (1, 7))
    assert [(r["id"], r["multitask"]["t"]) for r in joins.attach_targets(df, {"t": twice}).orderBy("id").collect()] == [(1, 7), (2, None)]
    with pytest.raises(Exception, match="repeats the id"):
        joins.complete_features(df, {"pitch": twice}).collect()


def test_fill_checks_every_side_whatever_is_read(spark):
    known = table(spark, "id string, src_audio string, src_n_frames int, tgt_audio string, tgt_n_frames int, pitch int, energy int", ("1", "s", 1, None, None, None, None))
    manifest = table(spark, "id string, tgt_audio string", ("1", None))
    with pytest.raises(Exception, match="not in the registry"):
        joins.fill_manifest(manifest, known, "s2s").select("id").collect()
    assert rows_of(joins.missing_from_registry(manifest, known, "s2s"), "id") == [("1",)]
    assert joins.fill_manifest(manifest.select("id"), known, "s2s").count() == 1


def test_repeated_positions_are_reported(spark):
    left, right = table(spark, "idx bigint, prediction string", (0, "a"), (0, "b"), (1, "c")), table(spark, "idx bigint, reference string", (0, "A"), (1, "C"))
    assert rows_of(joins.unpaired_positions(left, right), "idx", "only_in") == [(0, "repeated")]


def test_errors_after_the_post_net(spark):
    pairs = table(spark, "frame double, frame_gold double, frame_post double, pitch double, pitch_gold double, energy double, energy_gold double, log_duration double, duration_gold int", (1.0, 3.0, 2.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0))
    assert aggregates.regression_errors(pairs).first()["l1"] == 2.5
    assert aggregates.regression_errors(pairs.drop("frame_post")).first()["l1"] == 2.0


def test_thirteen_a_tokens_agree_on_ascii(spark):
    """The character class here and the published ranges give the same tokens around each symbol."""
    import re

    from corpusflow.catalog.common import SQL_13A_RULES

    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}" for c in range(32, 127) if chr(c) not in "&<"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize_13a(F.col("t")).alias("w"))
    for row in df.collect():
        text = f" {texts[row['i']]} "
        for pattern, replacement in SQL_13A_RULES:
            text = re.sub(pattern, replacement, text)
        assert row["w"] == text.split(), texts[row["i"]]
