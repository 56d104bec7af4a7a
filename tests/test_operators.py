"""Operators on small literal rows."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import canonical, hangul, numbers, phonology, streams, text
from lexiflow.operators import align, dedup, events, intervals, records, splits, state


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column, **fields):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in fields.items())
    return spark.createDataFrame([tuple(v for _, v in fields.values())], schema).select(column.alias("x")).first().x


TRACK = "event_id string, event_type string, session_id string, duration_ms int, score_overall double, cer double, is_correct boolean"


def test_tracking_of_nothing(spark):
    empty = spark.createDataFrame([], TRACK)
    r = events.tracking_summary(empty).first()
    assert (r.unique_sessions, r.chat_turns, r.pronun_cer_avg, r.topik_accuracy) == (0, 0, 0.0, 0.0)
    assert events.tracking_summary(empty, "nobody").first().unique_sessions == 1


def test_tracking_ignores_nulls(spark):
    df = spark.createDataFrame([("a", "pronun_scored", "s", 5, 1.0, None, None), ("b", "pronun_scored", "s", None, 0.5, None, None), ("c", "topik_answered", "s", 9, None, None, None), ("d", "topik_answered", "t", 1, None, None, True)], TRACK)
    r = events.tracking_summary(df, "").first()
    assert (r.pronun_score_avg, r.pronun_cer_avg, r.topik_answered, r.topik_correct, r.topik_accuracy, r.unique_sessions) == (0.75, 0.0, 2, 1, 0.5, 2)


def test_latest_prefers_later_arrival_on_ties(spark):
    df = spark.createDataFrame([("k", "t1", 1, "a"), ("k", "t1", 2, "b"), ("k", "t0", 3, "c")], "k string, t string, seq int, v string")
    assert values(records.latest_per_key(df, ["k"], ["t", "seq"]), "v") == [("b",)]


def test_excluding_recent_falls_back_to_all(spark):
    pool = spark.createDataFrame([(1,), (2,)], "k int")
    assert values(records.excluding_recent(pool, pool.where("k = 1"), "k"), "k") == [(2,)]
    assert values(records.excluding_recent(pool, pool, "k"), "k") == [(1,), (2,)]


def test_dense_ids(spark):
    df = spark.createDataFrame([(w, i) for i, w in enumerate("c a b a c d".split())], "w string, i int")
    assert values(records.ids_by_appearance(df, "w", ["i"]), "w", "id") == [("a", 1), ("b", 2), ("c", 0), ("d", 3)]
    assert values(records.ids_by_order(df, "w"), "w", "id") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_signatures(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "x"])], "i int, o array<string>")
    assert df.select(dedup.unordered_signature(F.lit("q"), options="o").alias("s")).distinct().count() == 1
    assert df.select(dedup.ordered_signature(F.array_join("o", "|")).alias("s")).distinct().count() == 2


def test_lexicon_merge(spark):
    a = spark.createDataFrame([("w", ["a"], 0), ("w", ["b"], 1)], "word string, phones array<string>, line_no int")
    b = spark.createDataFrame([("w", ["b"], 0), ("w", ["c"], 1)], "word string, phones array<string>, line_no int")
    assert dedup.merge_lexicons([a, b], 2).first().variants == [["a"], ["b"]]


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    out = splits.group_split(df, "g", {"train": 0.6, "test": 0.4}, "s")
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "test"}


def test_sliding_windows(spark):
    df = spark.createDataFrame([(0, 1500)], "start int, end int")
    assert values(intervals.sliding_windows(df, "start", "end", 600, 200), "window_start", "window_end") == [(0, 600), (200, 800), (400, 1000), (600, 1200), (800, 1400), (1000, 1500)]


def test_overlap_is_half_open_and_unique(spark):
    a = spark.createDataFrame([("k", 0, 100)], "k string, start int, end int")
    b = spark.createDataFrame([("k", 100, 200), ("k", 50, 260), ("k", -40, 0), ("j", 0, 9)], "k string, r_start int, r_end int")
    assert values(intervals.overlap_join(a, b, ["k"], 30), "r_start") == [(50,)]


def test_snap_prefers_left_edge(spark):
    p = spark.createDataFrame([(1, "k", 5.0), (2, "k", 9.0), (3, "k", 30.0)], "id int, k string, t double")
    w = spark.createDataFrame([("k", 0.0, 10.0)], "k string, start double, end double")
    assert values(intervals.snap_to_edges(p, w, ["k"], "id", "t", 6.0, 8.0), "id", "snapped") == [(1, 0.0), (2, 10.0), (3, 30.0)]


def test_merge_gaps_uses_the_furthest_end(spark):
    df = spark.createDataFrame([("k", 0, 100), ("k", 10, 20), ("k", 105, 110), ("k", 200, 201)], "k string, start int, end int")
    assert values(intervals.merge_gaps(df, ["k"], "start", "end", 10), "start", "end", "n") == [(0, 110, 3), (200, 201, 1)]


def test_hysteresis_dates_back():
    frames = [(c == "1",) for c in "0010111000011"]
    assert state.hysteresis(frames, 10, 20, 30) == [(40, 70), (110, 130)]


def test_unlike_last_kept_compares_with_kept(spark):
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "a b f e"), (4, "x")]
    assert state.unlike_last_kept(rows, 0.7) == [(1,), (3,), (4,)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, i long, t string")
    assert values(state.per_key(df, "k", ["i"], partial(state.unlike_last_kept, threshold=0.7), ["i", "t"], "kept long"), "kept") == [(1,), (3,), (4,)]


def test_machines():
    assert state.merge_pairs([("i", 1.0), ("a", 0.0), ("b", 0.5)], {("i", "a"): "ia"}) == [("ia", 0.5), ("b", 0.5)]
    assert state.compose_units([("a", 1), ("b", 1), ("ccc", 3), ("d", 2)]) == [("a b", 2), ("d", 2)]
    assert state.pack_to_target([(0, 5, False), (5, 9, False), (9, 12, True), (12, 20, False)], 8, 3, 100) == [(0, 9), (12, 20)]


def test_alignment():
    pairs, score = align.needleman_wunsch(list("abc"), list("abc"))
    assert pairs == [(0, 0), (1, 1), (2, 2)] and score == 3.0
    assert align.needleman_wunsch(list("ab"), []) == ([(0, -1), (1, -1)], -1.0)
    assert align.needleman_wunsch(["ㅐ"], ["ㅔ"], soft={("ㅔ", "ㅐ"): 0.8})[1] == 0.8


@pytest.mark.parametrize(("hyp", "ref", "expected"), [("", "", 0.0), ("a", "", 1.0), ("abcd", "abce", 0.25)])
def test_cer(spark, hyp, ref, expected):
    assert one(spark, align.cer(F.col("h"), F.col("r")), h=("string", hyp), r=("string", ref)) == expected


@pytest.mark.parametrize(("written", "said"), [("같이", "가치"), ("굳이", "구지"), ("읽고", "일꼬"), ("많이", "마니"), ("국물", "궁물"), ("신라", "실라"), ("값이", "갑씨"), ("독립", "동닙")])
def test_phonology(written, said):
    assert phonology.surface(written)[0] == said


def test_phonology_inserts_n():
    on = phonology.Options(n_insertion=True)
    assert [phonology.surface(w, on)[0] for w in ("담요", "색연필")] == ["담뇨", "생년필"]


@pytest.mark.parametrize(
    ("written", "said"),
    [("같이", "가치"), ("옷이", "오시"), ("많이", "마니"), ("굳히다", "구치다"), ("읽어요", "일거요"), ("읽고", "일꼬"), ("막히다", "마키다"), ("밟히다", "발피다"), ("좋아요", "조아요"), ("감다", "감따"), ("갈등", "갈뜽"), ("어디", "어디"), ("좋다", "조타"), ("담요", "담뇨"), ("서울역", "서울력"), ("나의", "나에"), ("회의실", "회이실"), ("같 이", "같 이")],
)
def test_phonology_with_all_rules(written, said):
    assert phonology.surface(written)[0] == said


def test_phonology_switches():
    on = phonology.Options
    assert phonology.surface("과외", on(collapse_w="second"))[0] == "가이" and phonology.surface("외과", on(collapse_w="perceptual"))[0] == "에가"
    assert phonology.surface("과외", on(collapse_wa=True))[0] == "가외" and phonology.surface("과", on(collapse_own=(("ㅘ", "ㅓ"),)))[0] == "거"
    assert [phonology.surface("의사", on(eui=e))[0] for e in ("auto", "keep", "i", "e")] == ["의사", "의사", "이사", "에사"]
    assert phonology.surface("담요", on(n_insertion=False))[0] == "다묘"


def test_numbers_spaced():
    assert [numbers.sino(n, spaced=True) for n in (0, 10, 123, 12_500, 100_000_000)] == ["영", "십", "백 이 십 삼", "일 만 이 천 오 백", "일 억"]
    assert numbers.VARIANTS["spaced"]("1.5km") == "일 점 오 킬로미터" and numbers.VARIANTS["spaced"]("12,500") == "일 만 이 천 오 백"


def test_range_rules_keep_equal_rows(spark):
    rows = spark.createDataFrame([(1, {"a": "b"}), (1, {"a": "b"}), (99, None)], "v int, m map<string,string>")
    rules = spark.createDataFrame([(0, 5, 2, "late"), (1, 3, 1, "early")], "lo int, hi int, idx int, kind string")
    assert sorted((r.v, r.kind or "") for r in records.range_rules(rows, rules, "v").collect()) == [(1, "early"), (1, "early"), (99, "")]
    with pytest.raises(ValueError, match="rules"):
        records.range_rules(rows, rules, "v", most=1)


def test_symbol_scores_may_be_negative(spark):
    soft = {("b", "p"): 0.6}
    df = spark.createDataFrame([(1, list("abc"), list("apx"))], "id int, r array<string>, h array<string>")
    df = df.withColumn("pairs", align.aligned(soft=soft)("r", "h")["pairs"])
    details = align.symbol_scores(df, "id", "r", "h", "pairs", soft=soft)
    assert [(x.ri, x.score) for x in details.orderBy("ri").collect()] == [(0, 1.0), (1, 0.6), (2, -1.0)]
    words = spark.createDataFrame([(1, 0, 0, "ab", 3.0), (1, 1, 0, "ab", 1.0), (1, 2, 1, "c", None)], "id int, ri int, word_no int, label string, duration double")
    got = {x.word_no: (x.n, round(x.avg_score, 6), round(x.avg_score_dur, 6), x.low) for x in align.word_scores(details, words, "id", "linear").collect()}
    assert got == {0: (2, 0.8, 0.9, ["b"]), 1: (1, -1.0, 0.0, ["c"])}
    one = align.overall_scores(details, words, "id", "linear").first()
    assert (one.n, round(one.avg_score, 6), round(one.avg_score_dur, 6)) == (3, 0.2, 0.9)


def test_greedy_decodes(spark):
    frames = [(1, i, label, p) for i, (label, p) in enumerate([("a", 0.9), ("a", 0.4), ("a", 0.2), ("a", 0.9), ("b", 0.4), ("b", 0.7)])]
    df = spark.createDataFrame(frames, "id int, i int, label string, p double")
    decode = lambda **o: align.greedy_decode(df, ["id"], "i", "label", "p", "_", 0.5, **o).first().decoded
    assert decode() == "aab" and decode(keep_blank=False) == "ab" and decode(release=0.3) == "aab" and decode(release=0.1) == "ab"


def test_hangul(spark):
    assert one(spark, hangul.jamo("t"), t=("string", "한글 a")) == "ㅎㅏㄴㄱㅡㄹ a"
    assert one(spark, hangul.skeleton("t"), t=("string", "한글")) == "ㅎㅏㄱㅡ"
    assert hangul.compose_text("ㅎㅏㄴㄱㅡㄹ") == "한글"
    assert hangul.chunks_of("가, 나!") == [("가,", ["ㄱ", "ㅏ"]), ("나!", ["ㄴ", "ㅏ"])]


def test_numbers():
    assert [numbers.sino(n) for n in (0, 10, 10000, 123456, 20_000_000)] == ["영", "십", "만", "십이만삼천사백오십육", "이천만"]
    assert numbers.VARIANTS["full"]("사과 3개와 20살, 12.5%") == "사과 세 개와 스무 살, 십이점 오 퍼센트"
    assert numbers.VARIANTS["speech"]("3:30") == "세시 반"
    assert numbers.VARIANTS["full"]("2024-06-17") == "이천이십사년 유월 십칠일"


def test_text(spark):
    assert one(spark, text.norm("t"), t=("string", " \tAb\n")) == "ab"
    assert one(spark, text.norm("t"), t=("string", None)) == ""
    assert one(spark, text.script_ratio("t"), t=("string", "가나 ab")) == 0.5
    assert one(spark, text.meaningful("t"), t=("string", "?!")) == "punctuation"
    assert one(spark, text.json_block("t"), t=("string", 'x {"a": [1,],} y')) == '{"a": [1]}'
    assert one(spark, text.tagged_block("t", "TEXT"), t=("string", "[text] 가 [/TEXT]")) == "가"
    assert one(spark, text.sentences("t"), t=("string", "A. B? C")) == ["A.", "B?", "C"]


@pytest.mark.parametrize(("given", "letter"), [("A", "A"), (" b ", "B"), ("1", "A"), ("4", "D"), (None, None), ("9", None)])
def test_answers(spark, given, letter):
    assert one(spark, canonical.answer_letter(F.col("a")), a=("string", given)) == letter


def test_choices(spark):
    assert one(spark, canonical.choices(F.col("m")), m=("map<string,string>", {"10": "j", "2": " b", "1": "a"})) == {"A": "a", "B": "b", "C": "j"}
    turns = one(spark, canonical.dialogue(F.col("d")), d=("array<string>", ["남자: 네", "그래요", " "]))
    assert [tuple(t) for t in turns] == [("남자", "네"), ("", "그래요")]


def test_streams():
    # At least four decomposed letters, compared without spaces and punctuation, cut from the text as it is written.
    assert streams.merge_overlap("hello wor", "world") == "hello wor world"
    assert streams.merge_overlap("hello worl", "world") == "hello world"
    assert streams.merge_overlap("abcx", "cxyz") == "abcx cxyz"
    assert streams.merge_overlap("안녕하", "녕하세요") == "안녕하세요" and streams.merge_overlap("네, 안녕", "안 녕하세요") == "네, 안녕하세요"
    assert streams.merge_overlap("", "가") == "가" and streams.merge_overlap("가 ", "나") == "가 나"
    assert streams.balanced_json('a {"b": "}"} c') == '{"b": "}"}'
    assert streams.highlight("abc", "abd") == "ab[d]"
    assert streams.tag_chunks("가 (bell) 나") == [{"kind": "text", "value": "가"}, {"kind": "sfx", "value": "bell"}, {"kind": "text", "value": "나"}]


def test_ipa_phonology():
    assert phonology.surface_ipa(["k", "u", "k̚", "m", "u", "l"]) == ["k", "u", "ŋ", "m", "u", "l"]
    assert phonology.surface_ipa(["i", "p̚", "h", "a"]) == ["i", "pʰ", "a"]
    assert phonology.surface_ipa(["s", "i", "n", "ɾ", "a"]) == ["s", "i", "l", "l", "a"]
    assert phonology.surface("부엌", phonology.IN_WORD)[0] == "부억"


def test_repairs(spark):
    df = spark.createDataFrame([(9, 3), (2, 3), (None, 30)], "score int, no int")
    got = df.select(canonical.repaired_score(F.col("score"), F.col("no"), {(1, 10): 4}).alias("s")).collect()
    assert [r.s for r in got] == [4, 2, 3]
    rows = spark.createDataFrame([("ab", 100), ("", 10)], "t string, size long")
    assert values(splits.usable_lengths(rows, "t", "size", 1, 5, 8), "frames") == [(12,)]


def test_clips_merge_split_and_drop(spark):
    rows = spark.createDataFrame([(1, 0, 100), (1, 150, 420), (1, 900, 930), (2, 0, 250)], "k int, s int, e int")
    got = values(intervals.clips(rows, ["k"], "s", "e", 50, 200, 40), "k", "start", "end")
    # 0..420 is one region over a gap of 50: its rest of 20 goes, as does 900..930; a rest of 50 stays.
    assert sorted(got) == [(1, 0, 200), (1, 200, 400), (2, 0, 200), (2, 200, 250)]


def test_advice_conditions(spark):
    rows = spark.createDataFrame([("u", 1, "l", "n", None, "liquid", "coda"), ("u", 2, "n", "a", "l", None, None), ("u", 3, "l", "n", "a", "liquid", None)], "k string, place int, sym string, next string, prev string, class string, env string")
    fields = "rule_idx int, tip string, covers array<string>, class_in array<string>, rule_env string, next_is_vowel boolean, pair_a array<string>, pair_b array<string>"
    rules = [(0, "vowel next", None, None, None, True, None, None), (1, "either way", None, None, None, None, ["n"], ["l", "r"]), (2, "liquid in a coda", None, ["liquid"], "coda", None, None, None), (3, "never", ["x"], None, None, False, None, None)]
    got = align.advice(rows, spark.createDataFrame(rules, fields), ["k"], "sym", vowels=("a",)).first()
    assert got.tips == ["either way", "liquid in a coda", "vowel next"]
    assert align.advice(rows, spark.createDataFrame(rules, fields), ["k"], "sym", 1).first().tips == ["either way"]
    with pytest.raises(ValueError, match="4 rules"):
        align.advice(rows, spark.createDataFrame(rules, fields), ["k"], "sym", most=3)
