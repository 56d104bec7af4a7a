"""Queries on text forms, ids, blocks and exam records over whole columns of the fixture tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, hangul, numbers, phonology, streams, text
from .catalogue import query, table

#: Latin letters stand for Hangul syllables, so that names of the part table become Korean words.
LATIN, KOREAN = "abcdefghijklmnopqrstuvwxyz", "각난답라말밥살알잦찾캌탙팦하고노도로모보소오조초코토"
K = f"translate(lower(p_name), '{LATIN}', '{KOREAN}')"
SPACE = r"[\s\p{Z}]"


def korean():
    return F.translate(F.lower("p_name"), LATIN, KOREAN)


def _strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g')")


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query(rf"""SELECT doc_id, {_collapse('text')} AS one_line,
  {_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t\x0B\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS lines FROM documents""")
def collapsed_texts(spark, sf_dir):
    """White space within texts and lines (H2, H3)."""
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse("text").alias("one_line"), text.collapse_lines("text").alias("lines"))


FIXES, ASKS = [("!!+", "!"), ("[%*$&#]{3}", "")], r"(?i)\b(who|of)\b"


@query(rf"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace({_collapse('text')}, '!!+', '!', 'g'), '[%*$&#]{{3}}', '', 'g') AS t FROM documents)
  SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[.!?。？！]$') OR regexp_matches(t, '{ASKS}') THEN t ELSE t || '.' END AS fixed FROM x""")
def fixed_sentences(spark, sf_dir):
    """Regex fixes in order and a final full stop (H4)."""
    return table(spark, sf_dir, "documents").select("doc_id", text.apply_fixes("text", FIXES, ASKS).alias("fixed"))


@query("""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
  SELECT doc_id, CASE trim(lower(lang)) WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE 'other' END AS section,
    CASE WHEN regexp_matches(t, '(?i)licen[sc]e') THEN 'licence' WHEN regexp_matches(t, '[0-9]{3}') THEN 'number' ELSE 'none' END AS rule,
    CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(1, length(t)) > 0.3 THEN 'math' WHEN length(t) > 400 THEN 'essay' WHEN regexp_matches(t, 'token|than') THEN 'vocabulary' ELSE 'general' END AS route,
    lower(trim(lang)) NOT IN ('fr') AS speech, trim(t, ' \t\n') <> '' AND NOT contains(lower(t), 'token =') AND NOT contains(lower(t), '@') AS valid FROM d""")
def document_routes(spark, sf_dir):
    """Tables of constants, first matching rules, routes, label and explanation predicates."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    return d.select("doc_id", text.mapped("lang", {"en": "english", "fr": "french"}, "other").alias("section"), text.first_rule("t", [("(?i)licen[sc]e", "licence"), ("[0-9]{3}", "number")], "none").alias("rule"), canonical.route(F.col("t"), ["token", "than"]).alias("route"), canonical.speech_labels(F.col("lang"), ["FR"]).alias("speech"), text.valid_explanation("t", ["token =", "@"]).alias("valid"))


@query(f"""WITH x AS (SELECT p_partkey, {K} || ', ab 12! ' || {K} AS t FROM part)
  SELECT p_partkey, array_to_string(regexp_extract_all(t, '[가-힣]+'), '|') AS tokens, array_to_string(regexp_extract_all(regexp_replace(t, '[^가-힣 ]', ' ', 'g'), '[가-힣]+'), '|') AS words, length(regexp_replace(t, '[^가-힣]', '', 'g')) AS syllables FROM x""")
def korean_tokens(spark, sf_dir):
    """Hangul tokens, words and syllables."""
    t = F.concat(korean(), F.lit(", ab 12! "), korean())
    return part(spark, sf_dir).select("p_partkey", F.array_join(text.tokens(t), "|").alias("tokens"), F.array_join(text.hangul_words(t), "|").alias("words"), text.syllables(t).cast("long").alias("syllables"))


def _jamo_sql(c: str, coda: bool) -> str:
    lists = [f"{x}" for x in (hangul.ONSETS, hangul.VOWELS, hangul.CODAS)]
    n = f"(unicode({c}) - 44032)"
    parts = [f"{lists[0]}[({n} // 588 + 1)::INT]", f"{lists[1]}[({n} % 588 // 28 + 1)::INT]", *([f"{lists[2]}[({n} % 28 + 1)::INT]"] if coda else [])]
    return f"CASE WHEN unicode({c}) BETWEEN 44032 AND 55203 THEN {' || '.join(parts)} ELSE {c} END"


@query(f"""WITH x AS (SELECT p_partkey, {K} AS k FROM part)
  SELECT p_partkey, array_to_string(list_transform(string_split(k, ''), lambda c: {_jamo_sql('c', True)}), '') AS jamo, array_to_string(list_transform(string_split(k, ''), lambda c: {_jamo_sql('c', False)}), '') AS skeleton,
    k AS composed, k AS normal, replace(array_to_string(list_transform(string_split(k, ''), lambda c: {_jamo_sql('c', True)}), ''), ' ', '') AS letters,
    array_to_string(list_transform(regexp_extract_all(k || '!', '[가-힣] *!?'), lambda c: replace(c, ' ', '')), '|') AS chunks FROM x""")
def jamo_forms(spark, sf_dir):
    """Syllables apart and together, normal forms, letters, chunks with punctuation."""
    k = part(spark, sf_dir).select("p_partkey", korean().alias("k"))
    return k.select(
        "p_partkey", hangul.jamo("k").alias("jamo"), hangul.skeleton("k").alias("skeleton"), hangul.compose(hangul.jamo("k")).alias("composed"), hangul.normalised("NFC")(hangul.normalised("NFD")("k")).alias("normal"),
        F.array_join(hangul.jamo_letters()("k"), "").alias("letters"), F.array_join(F.transform(hangul.syllable_chunks(F.concat("k", F.lit("!"))), lambda c: c["label"]), "|").alias("chunks"),
    )


SYMBOLS = list("abcdefghijklmnopqrstuvwx ")


@query(f"""WITH x AS (SELECT p_partkey, list_filter(string_split(p_name || 'Z', ''), lambda c: contains('{''.join(SYMBOLS)}', c)) AS l FROM part)
  SELECT p_partkey, array_to_string(list_transform(l, lambda c: (strpos('{''.join(SYMBOLS)}', c) - 1)::VARCHAR), ' ') AS ids, array_to_string(l, '') AS back FROM x""")
def symbol_ids(spark, sf_dir):
    """Characters as ids and back, unknown ones left out."""
    p = part(spark, sf_dir).select("p_partkey", text.symbol_ids(F.concat("p_name", F.lit("Z")), SYMBOLS).alias("ids"))
    return p.select("p_partkey", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), text.from_symbol_ids("ids", SYMBOLS).alias("back"))


@query(rf"""SELECT page_id, regexp_replace(coalesce(url, ''), '^[\p{{P}}\p{{S}}\s]+|[\p{{P}}\p{{S}}\s]+$', '', 'g') AS trimmed, regexp_replace(regexp_replace({_strip('url')}, '[^\p{{L}}\p{{N}}._-]+', '_', 'g'), '^_+|_+$', '', 'g')[1:80] AS slug,
  lower({_strip("replace(coalesce(url, ''), chr(92), '/')")}) AS path, CASE page_id % 3 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/wav' ELSE 'application/octet-stream' END AS mime,
  regexp_replace(url, '[\p{{Z}}\p{{P}}]', '', 'g') AS bare, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS speaker FROM pages""")
def page_names(spark, sf_dir):
    """Trimmed names, slugs, paths, kinds, bare texts and speakers."""
    p = table(spark, sf_dir, "pages")
    end = F.element_at(F.array(F.lit(".MP3"), F.lit(".wav"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    said = F.when(F.col("page_id") % 2 == 0, "Male 1").otherwise(" female 2")
    return p.select("page_id", text.trim_punctuation("url").alias("trimmed"), text.slug("url").alias("slug"), text.normal_path("url").alias("path"), text.mime(F.concat(F.lit("a"), end)).alias("mime"), text.bare("url").alias("bare"), text.speaker_id(said).alias("speaker"))


@query("""SELECT p_partkey, sha1('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '"}') AS id, sha1('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS blob FROM part""")
def stable_ids(spark, sf_dir):
    """Ids of canonical JSON and keys of derived files."""
    from ..sources.jsonl import blob_key

    return part(spark, sf_dir).select("p_partkey", text.stable_id("p_name", "p_brand").alias("id"), blob_key("p_size", "p_brand").alias("blob"))


@query("""SELECT p_partkey, p_name AS tagged, '{"a": {"b": "}' || p_brand || '"}}' AS greedy, '{"a": {"b": "}' || p_brand || '"}, }' AS balanced,
  'text:' || p_name || '|sfx:' || p_brand || '|text:' || p_type AS chunks, p_name AS correction, p_brand AS explanation, p_name || '[' || p_type || ']' AS marked FROM part""")
def blocks_and_tags(spark, sf_dir):
    """Tagged blocks, JSON within text, effects in parentheses, corrections, differences."""
    p = part(spark, sf_dir).withColumn("t", F.concat(F.lit("[TEXT] "), "p_name", F.lit(' [/TEXT] pre {"a": {"b": "}'), "p_brand", F.lit('"}, } post')))
    pieces = streams.chunks(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type"))
    fixed = text.correction_parts(F.concat("p_name", F.lit(" 설명: "), "p_brand"))
    return p.select(
        "p_partkey", text.tagged_block("t", "TEXT").alias("tagged"), text.json_block("t").alias("greedy"), streams.json_object("t").alias("balanced"), F.array_join(F.transform(pieces, lambda c: F.concat(c["kind"], F.lit(":"), c["value"])), "|").alias("chunks"),
        fixed["correction"].alias("correction"), fixed["explanation"].alias("explanation"), streams.highlighted(F.col("p_name"), F.concat("p_name", "p_type")).alias("marked"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 4 = p_partkey % 4 END AS same FROM part""")
def answers_checked(spark, sf_dir):
    """Answers equal but for case and spaces."""
    p = part(spark, sf_dir)
    letter = lambda n, small: F.char(n.cast("long") + (97 if small else 65))
    return p.select("p_partkey", text.same_answer(F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(letter(F.col("p_size") % 4, True)), F.concat(F.lit(" "), letter(F.col("p_partkey") % 4, False))).alias("same"))


@query("""SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding) + 1e-12) + 1e-12), 6) AS level, round_even(vec_id * 11025 / 1000, 0)::BIGINT AS samples FROM embeddings""")
def sample_levels(spark, sf_dir):
    """Levels of samples, samples of times."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(streams.dbfs(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("level"), streams.samples_of_ms(F.col("vec_id"), 11025).alias("samples"))


@query(f"""WITH l AS (SELECT p_partkey, list_transform(string_split('{LATIN}ABCDEFGHIJKLMNOPQRSTUVWXYZ ', ''), lambda c: [length(p_name) - length(replace(p_name, c, '')), length(p_type) - length(replace(p_type, c, ''))]) AS n FROM part)
  SELECT p_partkey, round(list_sum(list_transform(n, lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(n, lambda x: x[1] * x[1]))) * sqrt(list_sum(list_transform(n, lambda x: x[2] * x[2])))), 9) AS cosine FROM l""")
def letter_cosines(spark, sf_dir):
    """Cosine of count vectors."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x.rlike("[A-Za-z ]"))
    return part(spark, sf_dir).select("p_partkey", F.round(streams.count_cosine(letters("p_name"), letters("p_type")), 9).alias("cosine"))


#: Written words, how they sound by the rules, and the rules that apply.
SAID = {
    "같이": ("가치", "liaison,palatalise"), "굳이": ("구지", "liaison,palatalise"), "옷이": ("오시", "liaison"), "많이": ("마니", "h_loss"), "굳히다": ("구치다", "palatalise"), "읽어요": ("일거요", "liaison"), "읽고": ("일꼬", "tensify"),
    "막히다": ("마키다", "aspirate"), "밟히다": ("발피다", "aspirate"), "좋아요": ("조아요", "h_loss"), "국물": ("궁물", "nasalise"), "신라": ("실라", "liquidise"), "칼날": ("칼랄", "liquidise"), "감다": ("감따", "tensify"),
    "갈등": ("갈뜽", "tensify"), "좋다": ("조타", "aspirate"), "담요": ("담뇨", "n_insertion"), "나의": ("나에", "eui"), "회의실": ("회이실", "eui"), "어디": ("어디", ""),
}
SAID_ROWS = ", ".join(f"({i}, '{w}', '{s}', '{e}')" for i, (w, (s, e)) in enumerate(SAID.items()))


@query(f"WITH w(i, written, said, events) AS (VALUES {SAID_ROWS}) SELECT p_partkey, written || ' ' || p_name AS written, said || ' ' || p_name AS said, events FROM part JOIN w ON i = p_partkey % {len(SAID)}")
def surface_words(spark, sf_dir):
    """Surface forms and rules of a word beside each part's name, against the literal ones."""
    p = part(spark, sf_dir).withColumn("w", F.element_at(F.array(*map(F.lit, SAID)), (F.col("p_partkey") % len(SAID) + 1).cast("int")))
    p = p.select("p_partkey", F.concat("w", F.lit(" "), "p_name").alias("written"), "w")
    return p.select("p_partkey", "written", phonology.surface_form()("written")["clean"].alias("said"), F.array_join(F.transform(phonology.explained("w"), lambda c: c["type"]), ",").alias("events"))


IPA = {"k u k̚ m u l": "k u ŋ m u l", "i p̚ h a": "i pʰ a", "s i n ɾ a": "s i l l a", "h a k̚ k o": "h a k̚ k͈ o", "tɕ o h t a": "tɕ o tʰ a", "t o k̚ l i p̚": "t o ŋ n i p̚"}
IPA_ROWS = ", ".join(f"({i}, '{w}', '{s}')" for i, (w, s) in enumerate(IPA.items()))


@query(f"WITH w(i, written, said) AS (VALUES {IPA_ROWS}) SELECT p_partkey, written, said FROM part JOIN w ON i = p_partkey % {len(IPA)}")
def surface_phones(spark, sf_dir):
    """The rules on IPA sequences, against literal ones."""
    p = part(spark, sf_dir).select("p_partkey", F.element_at(F.array(*map(F.lit, IPA)), (F.col("p_partkey") % len(IPA) + 1).cast("int")).alias("written"))
    return p.select("p_partkey", "written", F.array_join(phonology.ipa_surface(F.split("written", " ")), " ").alias("said"))


def _sino99(n: str, gap: str = "") -> str:
    d = "['', '일', '이', '삼', '사', '오', '육', '칠', '팔', '구']"
    tens, ones = f"({n} // 10)", f"({n} % 10)"
    return f"array_to_string(list_filter([CASE WHEN {tens} > 1 THEN {d}[({tens} + 1)::INT] ELSE '' END, CASE WHEN {tens} > 0 THEN '십' ELSE '' END, {d}[({ones} + 1)::INT]], lambda s: s <> ''), '{gap}')"


def _native99(n: str) -> str:
    tens, ones = "['', '열', '스물', '서른', '마흔', '쉰']", "['', '한', '두', '세', '네', '다섯', '여섯', '일곱', '여덟', '아홉']"
    return f"CASE WHEN {n} = 20 THEN '스무' ELSE {tens}[({n} // 10 + 1)::INT] || {ones}[({n} % 10 + 1)::INT] END"


@query(f"""SELECT p_partkey, {_sino99('p_size', ' ')} || ' 킬로미터' AS spaced, {_sino99('p_size')} || ' 킬로미터' AS plain, {_native99('p_size')} || ' 개, ' || {_sino99('p_size')} || ' 원, ' || {_sino99('p_size')} || '년생' AS full_,
  CASE WHEN p_size BETWEEN 1 AND 12 THEN {_native99('p_size')} ELSE {_native99('p_size')} END || '시 반' AS speech, {_sino99('p_size')} || '쪽 end' AS cleaned FROM part""")
def numbers_in_words(spark, sf_dir):
    """The four verbalisers and a chain of cleaners."""
    n = F.col("p_size").cast("string")
    p = part(spark, sf_dir).select("p_partkey", F.concat(n, F.lit("km")).alias("a"), F.concat(n, F.lit("개, ₩"), n, F.lit(", "), n, F.lit("년생")).alias("b"), F.concat(n, F.lit("시 30분")).alias("c"), F.concat(F.lit("  "), n, F.lit("쪽 \n END")).alias("d"))
    return p.select("p_partkey", numbers.verbalised("spaced")("a").alias("spaced"), numbers.verbalised("plain")("a").alias("plain"), numbers.verbalised("full")("b").alias("full_"), numbers.verbalised("speech")("c").alias("speech"), numbers.cleaned(["lowercase", "numbers", "collapse"])("d").alias("cleaned"))


@query("""WITH p AS (SELECT *, ['B: ' || p_type, 'no speaker', ' '] AS lines FROM part)
  SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name END AS filled, CASE WHEN p_size % 3 = 0 THEN p_type || chr(10) || 'x' ELSE p_name END AS passage, 'B=' || p_type || '|=no speaker' AS turns,
    '1.2' AS version, p_size AS question_no, 'text' AS mode, 'A:' || p_brand || '|B:' || p_type AS choices, 'B' AS answer,
    p_name AS pack_prompt, 'pack' || p_size AS pack_id, p_name AS passage_view, CASE WHEN p_size % 2 = 0 THEN 'misc' ELSE p_type END AS topic, 'M=a|W=b|M=c' AS voices, 'A:2|B:1' AS remapped FROM p""")
def canonical_records(spark, sf_dir):
    """Raw columns as canonical records, their views, defaults and remapped scores."""
    c = F.col
    raw = part(spark, sf_dir).withColumn("lines", F.array(F.concat(F.lit("B: "), "p_type"), F.lit("no speaker"), F.lit(" ")))
    filled = canonical.first_filled(F.when(c("p_size") % 5 == 0, " ").otherwise(c("p_name")), "p_brand")
    passage = canonical.passage(F.when(c("p_size") % 3 == 0, "").otherwise(c("p_name")), F.array("p_type", F.lit(" x "), F.lit("")))
    record = canonical.canonical({"id": c("p_partkey"), "pack_id": F.concat(F.lit("pack"), c("p_size").cast("string")), "question_no": c("p_size"), "section": F.lit("listen"), "level": F.lit(1), "passage": c("p_name"), "question": c("p_name"), "options": canonical.choices(F.create_map(F.lit("2"), c("p_type"), F.lit("1"), c("p_brand"))), "answer": canonical.answer_letter(F.lit("2"))})
    topic, voices = canonical.with_defaults(F.when(c("p_size") % 2 == 0, " ").otherwise(c("p_type")), F.array(*(F.struct(F.lit(s).alias("speaker"), F.lit(t).alias("text")) for s, t in (("", "a"), ("W", "b"), ("", "c")))), ["M", "W"])
    order = F.array(*(F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for o, n in (("B", "A"), ("A", "B"))))
    shown = lambda xs, k, v, sep: F.array_join(F.transform(xs, lambda t: F.concat(t[k], F.lit(sep), t[v])), "|")
    done = raw.select("p_partkey", filled.alias("filled"), passage.alias("passage"), shown(canonical.dialogue(c("lines")), "speaker", "text", "=").alias("turns"), record.alias("r"), topic.alias("topic"), shown(voices, "speaker", "text", "=").alias("voices"), canonical.remapped_scores(F.create_map(F.lit("A"), F.lit(1), F.lit("B"), F.lit(2)), order).alias("m"))
    done = done.withColumn("pack", canonical.view(c("r"), False)).withColumn("from_passage", canonical.view(c("r"), True))
    return done.select(
        "p_partkey", "filled", "passage", "turns", c("r.version").alias("version"), c("r.question_no").alias("question_no"), c("r.passage.mode").alias("mode"), shown(c("r.question.choices"), "label", "text_ko", ":").alias("choices"), c("r.question.answer").alias("answer"),
        c("pack.prompt").alias("pack_prompt"), c("pack.pack_id").alias("pack_id"), c("from_passage.passage").alias("passage_view"), "topic", "voices", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), "|").alias("remapped"),
    )


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, '!!') THEN 'artifact' END, CASE WHEN length(t) < 200 THEN 'short' END, CASE WHEN lang = 'fr' THEN 'french' END], lambda x: x IS NOT NULL), ',') AS reasons,
    CASE WHEN {_strip('t')} = '' THEN 'empty' WHEN length({_strip('t')}) < 2 THEN 'too_short' WHEN regexp_replace({_strip('t')}, '[\p{{Z}}\p{{P}}]', '', 'g') = '' THEN 'punctuation' WHEN NOT regexp_matches(t, '[가-힣]') THEN 'no_hangul' END AS meaning,
    (1 + doc_id % 2)::INT AS level, 'listen' AS section, 27 AS first_question, chr((65 + doc_id % 4)::INT) AS option, '***' AS secret, lang AS plain, CASE WHEN doc_id % 9 BETWEEN 1 AND 5 THEN doc_id % 9 WHEN doc_id % 40 BETWEEN 1 AND 20 THEN 2 ELSE 3 END::INT AS score FROM d""")
def record_checks(spark, sf_dir):
    """Soft reasons, meaningful texts, parts of paths, masked fields, repaired scores."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    reasons = canonical.all_reasons([("artifact", F.col("t").contains("!!")), ("short", F.length("t") < 200), ("french", F.col("lang") == "fr")])
    at = canonical.path_parts(F.concat(F.lit("x\\topik"), (1 + F.col("doc_id") % 2).cast("string"), F.lit("\\listen\\27-28\\img_"), F.char(65 + F.col("doc_id") % 4), F.lit(".png")))
    hidden = canonical.redacted(F.create_map(F.lit("Api_Key"), F.col("source"), F.lit("lang"), F.col("lang")))
    return d.select("doc_id", F.array_join(reasons, ",").alias("reasons"), text.meaningful("t").alias("meaning"), at["level"].alias("level"), at["section"].alias("section"), at["first_question"].alias("first_question"), at["option"].alias("option"), hidden["Api_Key"].alias("secret"), hidden["lang"].alias("plain"), canonical.repaired_score((F.col("doc_id") % 9).cast("int"), (F.col("doc_id") % 40).cast("int"), {(1, 20): 2}).alias("score"))
